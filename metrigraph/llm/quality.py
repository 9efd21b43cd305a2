"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A document is the average of learned vectors of its features; the features of a word are its hashed form
and its hashed character n-grams with the word's ends marked, and, for the pair with the word before, whether it
is the same word. A softmax layer turns the average into class probabilities. As the average and the layer are linear, all a score needs of a word is its features' sum
of logits and their number, computed once for each distinct word of a slice of texts.

Training: `fit` takes at most `sample` labelled rows, those with the smallest hash of their id, a bound that
doesn't grow with the corpus, and trains in one executor task; only the model comes to the driver. Scoring reads
every whole text, in slices of about a megabyte (a longer text is a slice of its own). The model is buckets * 4
bytes for workers (one logit difference per bucket), whatever the corpus.

Defined results: null and empty texts have no features and get the bias alone; very long texts are scored whole; an
empty table gives no rows; ties of the id's hash are taken in order of id and label; ids, sources and languages
are never features; labels other than 0 and 1, null labels and labels of unknown ids are ignored; ids with
conflicting labels count with each; with fewer than two classes in the sample every score is the share of
class 1 (0.5 without labels). Repeated rows get equal scores; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrigraph.llm._text import BYTE_HASH, prefix_hash, slices, span_hash, utf8, words


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 18
    dim: int = 16
    least: int = 3
    most: int = 3
    epochs: int = 3
    rate: float = 0.3
    batch: int = 16
    seed: int = 7
    sample: int = 3000


@dataclass(frozen=True)
class Model:
    """logits: class-1 minus class-0 logit of each bucket's vector."""

    params: Params
    logits: np.ndarray
    bias: float


def pair_buckets(p: Params) -> np.ndarray:
    """Buckets of the word pairs (another word, the same word)."""
    buf = np.frombuffer(b"\0other\0same", np.uint8)
    return (span_hash(prefix_hash(buf, BYTE_HASH), np.array([0, 6]), np.array([6, 11])) % np.uint64(p.buckets)).astype(np.int64)


def word_features(word: bytes, p: Params) -> np.ndarray:
    """Buckets of the word itself and its character n-grams (in bytes, ends marked)."""
    marked = b"<" + word + b">"
    n = len(marked)
    h = prefix_hash(np.frombuffer(marked, np.uint8), BYTE_HASH)
    starts, ends = [np.zeros(1, np.int64)], [np.full(1, n)]
    for size in range(p.least, min(p.most, n - 1) + 1):
        s = np.arange(n - size + 1)
        starts.append(s)
        ends.append(s + size)
    return (span_hash(h, np.concatenate(starts), np.concatenate(ends)) % np.uint64(p.buckets)).astype(np.int64)


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of these words, and the word each belongs to; as word_features, in numpy."""
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum(lens + 2)))
    marked = np.full(at[-1], ord("<"), np.uint8)
    inner = np.repeat(at[:-1] + 1 - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
    marked[inner] = buf[np.repeat(starts - at[:-1] - 1, lens) + inner]
    marked[at[1:] - 1] = ord(">")
    h = prefix_hash(marked, BYTE_HASH)
    ids, owner = [span_hash(h, at[:-1], at[1:])], [np.arange(len(lens))]
    for size in range(p.least, p.most + 1):
        some = np.maximum(lens + 2 - size + 1, 0) * (lens + 2 > size)
        s = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(some)[:-1])), some) + np.arange(some.sum())
        ids.append(span_hash(h, s, s + size))
        owner.append(np.repeat(np.arange(len(lens)), some))
    return (np.concatenate(ids) % np.uint64(p.buckets)).astype(np.int32), np.concatenate(owner)


def _sparse(text: bytes, p: Params, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets, and their share among its features."""
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(buf, np.array([0, len(buf)]))
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    keys = span_hash(prefix_hash(buf, BYTE_HASH), starts, ends)
    _, first, at, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    ids, owner = features(buf, starts[first], ends[first], p)
    same = int((at[1:] == at[:-1]).sum())
    ids, weight = np.concatenate((ids, pairs.astype(np.int32))), np.concatenate((times[owner], [len(at) - 1 - same, same]))
    u, of = np.unique(ids[weight > 0], return_inverse=True)
    n = np.bincount(of, weight[weight > 0], len(u))
    return u, (n / n.sum()).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, p: Params = Params()) -> Model:
    """Softmax over two classes on averaged vectors; minibatch SGD with linearly falling rate."""
    labels = np.asarray(labels, np.int64)
    if len(np.unique(labels)) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(p, np.zeros(p.buckets, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    out = np.zeros((p.dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    weight = (len(labels) / (2 * np.bincount(labels, minlength=2)))[labels].astype(np.float32)  # both classes count alike
    pairs = pair_buckets(p)
    docs = [_sparse(t, p, pairs) for t in texts]
    steps = p.epochs * -(-len(docs) // p.batch)
    step = 0
    for _ in range(p.epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), p.batch):
            pick = order[at : at + p.batch]
            rate = np.float32(p.rate * (1 - step / steps))
            step += 1
            hidden = np.stack([docs[i][1] @ vectors[docs[i][0]] for i in pick])
            z = hidden @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            grad = (z / z.sum(axis=1, keepdims=True) - np.eye(2, dtype=np.float32)[labels[pick]]) * weight[pick, None]
            back = grad @ out.T
            out -= rate * (hidden.T @ grad) / len(pick) * p.dim
            bias -= rate * grad.mean(axis=0)
            for i, b in zip(pick, back, strict=True):
                vectors[docs[i][0]] -= (rate * p.dim) * docs[i][1][:, None] * b  # ids of a text are distinct
    return Model(p, vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


class Scorer:
    """Scores batches of texts: the distinct words of a slice of texts are looked up once."""

    def __init__(self, model: Model):
        self.model, self.pairs = model, model.logits[pair_buckets(model.params)].astype(np.float64)

    def __call__(self, column: pa.Array) -> np.ndarray:
        """The logit of every text, which doesn't depend on the texts beside it."""
        buf, offs = utf8(column)
        out = np.full(len(offs) - 1, self.model.bias)
        for i, j in slices(offs):
            part = buf[offs[i] : offs[j]]
            starts, ends, counts = words(part, offs[i : j + 1] - offs[i])
            if not len(starts):
                continue
            keys = span_hash(prefix_hash(part, BYTE_HASH), starts, ends)
            _, first, at = np.unique(keys, return_index=True, return_inverse=True)
            sums, ns = self._vocabulary(part, starts[first], ends[first])
            text = np.repeat(np.arange(j - i), counts)
            follows = text[1:] == text[:-1]
            same = (at[1:] == at[:-1])[follows]
            pairs = np.bincount(text[1:][follows], self.pairs[same.astype(np.int64)], j - i)
            total = np.bincount(text, ns[at], j - i) + np.maximum(counts - 1, 0)
            out[i:j] += (np.bincount(text, sums[at], j - i) + pairs) / np.maximum(total, 1)
        return out

    def _vocabulary(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit sums and feature numbers of distinct words."""
        ids, owner = features(buf, starts, ends, self.model.params)
        return np.bincount(owner, self.model.logits[ids], len(starts)), np.bincount(owner, minlength=len(starts))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", p: Params = Params()) -> Model:
    """Trains on at most p.sample labelled rows, chosen by the hash of their id."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1)").distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # Ids are chosen before texts move: only the sample's texts reach the driver.
    chosen = known.join(rows.select("_id").distinct(), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id", "_label").limit(p.sample)
    sample = rows.join(F.broadcast(chosen), "_id").select(F.xxhash64("_id").alias("h"), F.col("_label").alias("label"), F.col("_text").alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("h", "ascending"), ("label", "ascending"), ("text", "ascending")])
        model = train(table["text"].cast(pa.large_binary()).to_pylist(), table["label"].to_numpy(), p)
        yield pa.RecordBatch.from_arrays([pa.array([model.logits.tobytes()]), pa.array([model.bias])], ["logits", "bias"])

    got = sample.repartition(1).mapInArrow(run, "logits binary, bias double").first()  # p.sample rows at most in one task
    return Model(p, np.frombuffer(got["logits"], np.float32), got["bias"]) if got else train([], np.zeros(0), p)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the probability of class 1; a column named out_col is replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name != out_col]
    schema = T.StructType([*fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            z = np.clip(scorer(batch[text_col]), -700, 700)
            kept = [batch[f.name] for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-z)))], [*[f.name for f in fields], out_col])

    return docs.select(*[f.name for f in fields]).mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
