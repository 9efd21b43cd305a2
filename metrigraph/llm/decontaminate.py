"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Every training text is cut into overlapping passages, half overlapping and at least twice as long as the items they
are compared with, so that some passage holds any item whole: items are indexed by length, in classes whose longest
have a power of two of words, each with passages of its own. Each passage is a query against an index of
items; scores are BM25 divided by the item's score for itself, so 1 means "all its terms", and all items
at or above the threshold are retrieved. A hit is verified by the share of word trigrams of the item's
question and of its answer that the passage holds; both must pass.

Terms that many items hold and whose greatest impacts together stay below most of the threshold are no reason
to search. For the other terms numpy adds up the impacts by passage and item for a whole slice of texts;
where that and the common terms' greatest impacts stay below the threshold for every item, the passage
can't hold a hit. Only the rest are searched.

The indexes are broadcast. Their size follows the benchmark, not the corpus, and is checked: items are
indexed in blocks of at most `block_bytes` of text, one pass each. Document frequencies, the number of items and
their mean length are those of all items, so scores don't depend on blocks and classes.

Defined results: null and empty texts and items match nothing; a question or answer of fewer than
SHORT words is verified by its words; repeated items each match; repeated documents each match; of passages that tie in score the
one of greater overlaps is told; very long texts are searched whole; an empty table gives no hits; extra columns of
any name stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrigraph.llm._text import BYTE_HASH, NOT_ALNUM, prefix_hash, slices, span_hash, utf8, words

_ANSWER = re.compile(r"\b(?:answer|antwort|réponse|respuesta)\s*:|\?\s", re.I)


@dataclass(frozen=True)
class Params:
    threshold: float = 0.5
    question: float = 0.5
    answer: float = 0.5
    passage: int = 128
    block: int = 16
    k1: float = 1.2
    b: float = 0.75
    block_bytes: int = 32 << 20


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and how many each text has."""
    buf, offs = utf8(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in slices(offs):
        part = buf[offs[i] : offs[j]]
        s, e, n = words(part, offs[i : j + 1] - offs[i], NOT_ALNUM)
        counts.append(n)
        hashes.append(span_hash(prefix_hash(part, BYTE_HASH), s, e))
    return np.concatenate(hashes), np.concatenate(counts)


#: Parts of fewer words are verified by their words: of so few trigrams a changed word takes most.
SHORT = 8


def trigrams(h: np.ndarray, least: int = 3) -> np.ndarray:
    """Hashes of the word trigrams; of the words, if there are fewer than `least`."""
    if len(h) < least:
        return np.unique(h)
    return np.unique(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) ^ h[2:])


def question_words(text: str, n_words: int) -> int:
    """How many leading words are the question: up to an answer's mark or a question mark, else two thirds."""
    m = None
    for m in _ANSWER.finditer(text):
        pass
    if m and text[m.end() :].strip():
        head = len(tokens(pa.array([text[: m.end()]]))[0])
        if 0 < head < n_words:
            return head
    return -(-2 * n_words // 3)


@dataclass
class Index:
    """terms: sorted hashes; postings of term t: rows first[t]:first[t+1] of (doc, impact), in blocks."""

    params: Params
    ids: list
    terms: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    most: np.ndarray
    longest: int
    question: list[np.ndarray]
    answer: list[np.ndarray]
    present: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.present = np.zeros(1 << 18, bool)
        self.present[(self.terms & np.uint64(0x3FFFF)).astype(np.int64)] = True
        size = self.params.block
        order = np.argsort(np.diff(self.first))[::-1]
        self.common = np.zeros(len(self.terms), bool)
        self.common[order[np.cumsum(self.most[order]) < self.params.threshold / 2]] = True
        self.lists = []
        for t in range(len(self.terms)):
            a, b = self.first[t], self.first[t + 1]
            d, v = self.doc[a:b].tolist(), self.impact[a:b].tolist()
            self.lists.append((d, v, [d[min(i + size, len(d)) - 1] for i in range(0, len(d), size)], [max(v[i : i + size]) for i in range(0, len(d), size)]))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Term of each word, -1 if no item has it."""
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.present[(h & np.uint64(0x3FFFF)).astype(np.int64)])
        if len(self.terms):
            t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
            out[at] = np.where(self.terms[t] == h[at], t, -1)
        return out


@dataclass(frozen=True)
class Statistics:
    """Of all items: their number, mean length in words, and how many items hold each term (sorted hashes)."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def statistics(texts: Iterator[list[str | None]]) -> Statistics:
    items, total, terms, df = 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in texts:
        h, n = tokens(pa.array(part, pa.string()))
        u, at = np.unique(h, return_inverse=True)
        pairs = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(u)) + at)
        own = np.bincount(pairs % max(1, len(u)), minlength=len(u))
        terms, at = np.unique(np.concatenate((terms, u)), return_inverse=True)
        df = np.bincount(at, np.concatenate((df, own)), len(terms)).astype(np.int64)
        items, total = items + len(n), total + int(n.sum())
    return Statistics(items, total / max(1, items), terms, df)


def length_class(n: np.ndarray) -> np.ndarray:
    """The least power of two that isn't below a number of words."""
    return 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def build(ids: list, texts: list[str | None], p: Params = Params(), stats: Statistics | None = None, longest: int | None = None) -> Index:
    """An index of these items; stats: of all items, if there are others; longest: words of the longest item of the class."""
    stats = stats or statistics(iter([texts]))
    h, n = tokens(pa.array(texts, pa.string()))
    at = np.concatenate(([0], np.cumsum(n)))
    terms, term = np.unique(h, return_inverse=True)
    item = np.repeat(np.arange(len(ids)), n)
    pair, tf = np.unique(term * max(1, len(ids)) + item, return_counts=True)
    term, item = pair // max(1, len(ids)), pair % max(1, len(ids))
    df = stats.df[np.searchsorted(stats.terms, terms)]
    idf = np.log(1 + (stats.items - df + 0.5) / (df + 0.5))
    norm = p.k1 * (1 - p.b + p.b * n / max(1.0, stats.mean))
    impact = idf[term] * tf * (p.k1 + 1) / (tf + norm[item])
    impact /= np.bincount(item, impact, len(ids))[item]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    most = np.maximum.reduceat(impact, first[:-1]) if len(terms) else np.zeros(0)
    q = [question_words(t or "", int(k)) for t, k in zip(texts, n, strict=True)]
    question = [trigrams(h[a : a + k], SHORT) for a, k in zip(at, q, strict=False)]
    answer = [trigrams(h[a + k : b], SHORT) for a, b, k in zip(at, at[1:], q, strict=False)]
    return Index(p, ids, terms, first, item, impact, most, longest or int(n.max(initial=0)), question, answer)


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items whose score for these distinct terms is at least the threshold."""
    size, end = index.params.block, len(index.ids)
    most, lists, slack = index.most, index.lists, threshold - 1e-9
    cursors = [[lists[t][0][0], 0, t] for t in terms]  # current item, its place, term
    found = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += most[c[2]]
            if bound >= slack:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        block_bound, until = 0.0, end
        for c in cursors[: pivot + 1]:  # shallow move: the block that would hold the pivot item
            d, _, last, peak = lists[c[2]]
            b = bisect_left(last, item, c[1] // size)
            if b < len(last):
                block_bound += peak[b]
                until = min(until, last[b] + 1)
        if block_bound < slack:  # no item before the nearest block end can pass
            if pivot + 1 < len(cursors):
                until = min(until, cursors[pivot + 1][0])
            to = max(until, item + 1)
        elif cursors[0][0] == item:
            score = sum(lists[c[2]][1][c[1]] for c in cursors[: pivot + 1])
            if score >= slack:
                found.append((item, score))
            to = item + 1
        else:
            to = item
        for c in cursors[: pivot + 1]:
            d = lists[c[2]][0]
            i = c[1] if d[c[1]] >= to else bisect_left(d, to, c[1])
            c[1], c[0] = i, d[i] if i < len(d) else end
        cursors = [c for c in cursors if c[0] < end]
    return found


def _bounds(index: Index, passage: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each passage an upper bound of its best score; (passage, t) are its distinct terms."""
    n = int(passage.max(initial=-1)) + 1
    rare = ~index.common[t]
    common = np.bincount(passage[~rare], index.most[t[~rare]], n)
    best = np.zeros(n)
    pas, ter = passage[rare], t[rare]
    df = np.diff(index.first)
    for at in _runs(np.cumsum(df[ter]), pas):  # whole passages, about a million postings at once
        p_, t_ = pas[at], ter[at]
        d = df[t_]
        row = np.repeat(index.first[t_] - np.concatenate(([0], np.cumsum(d)[:-1])), d) + np.arange(d.sum())
        low = p_[0]
        key = np.repeat(p_ - low, d) * len(index.ids) + index.doc[row]
        width = (int(p_[-1]) - low + 1) * len(index.ids)
        if width <= 1 << 23:
            s = np.bincount(key, index.impact[row], width).reshape(-1, len(index.ids)).max(axis=1)
            best[low : low + len(s)] = np.maximum(best[low : low + len(s)], s)
        else:
            u, inv = np.unique(key, return_inverse=True)
            np.maximum.at(best, low + u // len(index.ids), np.bincount(inv, index.impact[row]))
    return best + common


def _runs(total: np.ndarray, group: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Slices of whole groups (sorted) over which `total`, a running sum, grows by about `most`."""
    i = 0
    while i < len(group):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right"))
        j = int(np.searchsorted(group, group[max(i, min(j, len(group) - 1))], "right"))
        yield slice(i, j)
        i = j


def search(indexes: list[Index], column: pa.Array) -> Iterator[tuple[int, object, float, float, float]]:
    """(text, item's id, score, question overlap, answer overlap) of verified hits, the best passage of each pair."""
    for i, j in slices(utf8(column)[1]):
        h, counts = tokens(column.slice(i, j - i))
        for index in indexes:
            for row, item, *rest in _search(index, h, counts):
                yield row + i, index.ids[item], *rest


def _search(index: Index, h: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
    p = index.params
    if not len(h) or not len(index.terms):
        return
    length = max(p.passage, 2 * index.longest)
    step = length // 2
    begin = np.concatenate(([0], np.cumsum(counts)))
    text = np.repeat(np.arange(len(counts)), counts)
    term = index.find(h)
    known = np.flatnonzero(term >= 0)
    half = (known - begin[text[known]]) // step  # passage k holds halves k and k+1
    n_half = -(-counts // step)
    base = np.concatenate(([0], np.cumsum(np.maximum(n_half, 1))))
    late = base[text[known]] + half
    early = np.where(half > 0, late - 1, late)
    keys = np.sort(np.concatenate((late, early)) * len(index.terms) + np.concatenate((term[known], term[known])))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]]
    passage, t = keys // len(index.terms), keys % len(index.terms)
    bound = _bounds(index, passage, t)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    cut = np.searchsorted(passage, np.arange(len(bound) + 1))
    for w in np.flatnonzero(bound >= p.threshold - 1e-9):
        found = block_max_wand(index, t[cut[w] : cut[w + 1]].tolist(), p.threshold)
        if not found:
            continue
        i = int(np.searchsorted(base, w, "right")) - 1
        a = begin[i] + (w - base[i]) * step
        grams = words_ = None
        for item, score in found:
            if grams is None:
                words_ = h[a : min(a + length, begin[i + 1])]
                grams = trigrams(words_) if len(words_) >= 3 else np.unique(words_)
                grams = np.concatenate((grams, np.unique(words_)))
            share = [float(np.isin(x, grams).mean()) if len(x) else 1.0 for x in (index.question[item], index.answer[item])]
            if share[0] >= p.question and share[1] >= p.answer:
                best[i, item] = max(best.get((i, item), (0.0, 0.0, 0.0)), (score, *share))
    for (i, item), x in sorted(best.items()):
        yield i, item, *x


def indexes(items: DataFrame, id_col: str, text_col: str, p: Params) -> Iterator[list[Index]]:
    """Indexes over all items by blocks of about p.block_bytes of text; only one block is on the driver at a time."""
    items = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // p.block_bytes) or 1

    def block(k: int) -> list[dict]:
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        return sorted(part.toArrow().to_pylist(), key=lambda r: (r["id"] is None, r["id"], r["text"] or ""))

    stats = statistics([r["text"] for r in block(k)] for k in range(blocks))
    for k in range(blocks):
        rows = block(k)
        of = length_class(tokens(pa.array([r["text"] for r in rows], pa.string()))[1])
        out = []
        for size in np.unique(of).tolist():
            mine = [r for r, c in zip(rows, of, strict=True) if c == size]
            out.append(build([r["id"] for r in mine], [r["text"] for r in mine], p, stats, size))
        yield out


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", p: Params = Params()) -> DataFrame:
    """(doc_id, item_id, score, question, answer) of every verified hit."""
    out = None
    for part in indexes(items, item_id, item_text, p):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(search(held.value, batch["text"]))
                ids = batch["id"].take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4)]], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", p: Params = Params()) -> DataFrame:
    """The documents without a verified hit, with all their columns."""
    for part in indexes(items, item_id, item_text, p):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[r[0] for r in search(held.value, batch[text_col])]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2(spark, sf_dir: str) -> DataFrame:
    return hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
