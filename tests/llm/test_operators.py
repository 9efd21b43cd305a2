"""Each operator on a small awkward corpus against brute force, and on empty tables."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from metrigraph.llm import bank, decontaminate, ngram_lm, quality, simhash, suffix_dedup

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 9))) for _ in range(400)]
prose = lambda n: " ".join(RNG.choice(VOCAB) for _ in range(n))
ITEMS = [prose(30) for _ in range(5)]
PASSAGE = prose(120)


def corpus():
    texts = [None, "", " ", "one", "One  TWO", "é è", "token = \"0123456789abcdef0123456789abcdef\"", "x" * 3000, "ab " * 2000]
    texts += [prose(RNG.randint(5, 200)) for _ in range(60)]
    texts += [texts[20], texts[20], texts[21].upper(), texts[22] + " tail"]
    texts += [prose(20) + " " + ITEMS[i % 5] + " " + prose(20) for i in range(6)]
    texts += [prose(50) + "\n" + PASSAGE + "\n" + prose(50) for _ in range(4)]
    texts += [" ".join(w for w in RNG.choices(VOCAB, k=20) for _ in range(10)) for _ in range(20)]
    texts.append(prose(30000))
    rows = [(i, t, "en", RNG.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[30], rows[30], (None, "no id here", None, None, None), (None, None, None, None, None)]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("key", pa.string()), ("size", pa.int64())])
PAGES = ["<nav><a href=x>Menu</a></nav><article><h1>Title &amp; more</h1><p>First text, of some length.<p>Second</article><footer>Foot</footer>", None, "", "<p", "<article><p>unclosed " + "word " * 5000, "<!-- open", '<a "\'"\'"\' <b>text here', "<div>" * 2000 + "deep text in here, enough."]


def write(folder, rows, empty=False):
    folder.mkdir()
    docs = [] if empty else rows
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, (*r, "clash", 1), strict=True)) for r in docs], SCHEMA), folder / "documents.parquet")
    labels = [] if empty else [(r[0], 0 if r[1] and len(set(r[1].split())) * 5 < len(r[1].split()) else 1, 0) for r in rows] + [(10**6, 1, 0), (3, None, None)]
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), folder / "labels.parquet")
    items = [] if empty else [*ITEMS, None, ""]
    pq.write_table(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}), folder / "benchmark.parquet")
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 16))
    base[40:60] = base[:20] + 0.1 * rng.normal(size=(20, 16))
    base[60:70] = base[0]
    vectors = [] if empty else [*base.tolist(), None, [], [0.0] * 16, [math.nan] * 16, [1e300] * 16, [1.0] * 16, [1.0] * 8, [None] * 16]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float64())), "label": pa.array([0] * len(vectors), pa.int32())}), folder / "embeddings.parquet")
    pages = [] if empty else PAGES
    pq.write_table(pa.table({"page_id": pa.array(range(len(pages)), pa.int64()), "url": pa.array(["u"] * len(pages), pa.string()), "html": pa.array(pages, pa.string())}), folder / "pages.parquet")
    chats = [] if empty else [(1, 0, "system", "be"), (1, 1, "user", "a<|im_end|>&lt;|b&amp;"), (1, 2, "assistant", None), (2, None, None, "x"), (2, 5, "assistant", "y"), (2, 5, "assistant", "y"), (None, 0, "us\ner", "<|im_start|>"), (3, 0, "assistant", "&nl;<")]
    pq.write_table(pa.table({n: pa.array([c[k] for c in chats], t) for k, (n, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))}), folder / "conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def sf(tmp_path_factory, rows):
    return write(tmp_path_factory.mktemp("data") / "sf", rows)


@pytest.fixture(scope="module")
def got(spark, sf):
    cache = {}

    def of(name):
        if name not in cache:
            cache[name] = [r.asDict() for r in bank.queries()[name](spark, sf).collect()]
        return cache[name]

    return of


@pytest.mark.parametrize("name", sorted(bank.queries()))
def test_empty_tables(spark, tmp_path, name):
    out = bank.queries()[name](spark, write(tmp_path / "empty", [], True)).collect()
    assert len(out) == (1 if name == "op10_chat" else 0)


def words(t):
    return (t or "").encode().lower().split()


def multiset(found, names):
    return Counter(tuple(r[n] for n in names) for r in found)


def test_quality(got, rows):
    out = got("op1_quality")
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    by = {}
    for r in out:
        assert by.setdefault(r["doc_id"], r["score"]) == r["score"] or r["doc_id"] is None


def test_quality_scores_agree_with_features():
    model = quality.train([b"good words here", b"bad bad bad bad"] * 20, np.array([1, 0] * 20))
    text = b"some \xc3\xa9 words words"
    f, pairs = [quality.word_features(w, model.params) for w in text.split()], quality.pair_buckets(model.params)[[0, 0, 1]]
    z = model.logits[np.concatenate([*f, pairs])].astype(float).mean() + model.bias
    assert quality.Scorer(model)(pa.array([text.decode(), "", None]))[:3] == pytest.approx([z, model.bias, model.bias], abs=1e-5)


def test_decontaminate(got, rows):
    want = {(r[0], i) for r in rows for i, x in enumerate(ITEMS) if r[1] and x in r[1]}
    assert want and {(r["doc_id"], r["item_id"]) for r in got("op2_decontaminate")} == want


def test_block_max_wand():
    index = decontaminate.build(list(range(60)), [prose(25) for _ in range(60)], decontaminate.Params(block=4))
    rng = np.random.default_rng(1)
    for _ in range(100):
        terms = np.unique(rng.integers(0, len(index.terms), rng.integers(1, 90))).tolist()
        scores = np.zeros(60)
        for t in terms:
            scores[index.doc[index.first[t] : index.first[t + 1]]] += index.impact[index.first[t] : index.first[t + 1]]
        for least in (0.05, 0.2, 0.5):
            assert {i for i, _ in decontaminate.block_max_wand(index, terms, least)} == set(np.flatnonzero(scores >= least - 1e-9))


def test_language_model(got, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r[0]) for w in [*words(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        w = [*words(t), None]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    out = got("op3_ngram_lm")
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out) == want
    assert all(r["score"] < 0 for r in out)


def test_language_model_learns_weights_from_all_texts(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(VOCAB[:40], k=30)) for _ in range(450)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    fit, sums = ngram_lm._fit_weights, []

    def spy(model, *counts):
        sums.append(int(counts[-1].sum()))
        return fit(model, *counts)

    monkeypatch.setattr(ngram_lm, "_fit_weights", spy)
    for p in (ngram_lm.Params(), ngram_lm.Params(shard_bytes=200)):
        out = ngram_lm.score(train, train, p=p).collect()
        assert len(out) == 450 and sums.pop() == 450 * 31
        sums.append(sorted(round(r["score"], 6) for r in out))
    assert sums[0] == sums[1]


def test_mixing(got, rows):
    out = got("op4_mixing")
    assert multiset(out, ["doc_id", "size"]) == Counter((r[0], len(words(r[1]))) for r in rows)
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in out)
    assert sum({r["source_size"]: r["target"] for r in out}.values()) == pytest.approx(1.5 * sum(r["size"] for r in out))


def test_vectors(got, sf):
    v = pq.read_table(f"{sf}/embeddings.parquet")["embedding"].to_pylist()
    ok = [i for i, x in enumerate(v) if x and all(y is not None and math.isfinite(y) for y in x) and any(x)]
    unit = {i: np.array(v[i]) / max(map(abs, v[i])) for i in ok}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    links = {i: {j for j in ok if j != i and len(v[i]) == len(v[j]) and unit[i] @ unit[j] >= 0.9} for i in range(len(v)) if i in unit}
    for r in got("op5_vectors"):
        reach, todo = set(), [r["vec_id"]]
        while todo:
            x = todo.pop()
            if x not in reach:
                reach.add(x)
                todo += links.get(x, ())
        assert (r["n_links"], r["component_id"], r["kept"]) == (len(links.get(r["vec_id"], ())), min(reach), r["vec_id"] == min(reach))


def test_suffix_dedup(got, rows):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = Counter()
    for r, t in zip(rows, texts, strict=True):
        cover = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                cover[i : i + 400] = True
        cover = cover[:-1] if len(t) else cover[:0]
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        want[r[0], len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert multiset(got("op6_suffix_dedup"), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == want


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for n, k in ((60, 1), (300, 2), (900, 3)):
        buf = rng.integers(97, 97 + k, n).astype(np.uint8)
        raw = buf.tobytes()
        sa = suffix_dedup.suffix_array(buf)
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        common = lambda a, b: next((m for m in range(40) if raw[a + m : a + m + 1] != raw[b + m : b + m + 1] or a + m >= n or b + m >= n), 40)  # noqa: E731, B023
        assert suffix_dedup.kasai(buf, sa, 40).tolist() == [0, *map(common, sa.tolist(), sa.tolist()[1:])]


def test_merging_shards():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = ([bytes(rng.integers(97, 99, rng.integers(10, 25)).astype(np.uint8)) for _ in range(4)] for _ in range(2))
        cut = lambda cs: {c[i : i + 10] for c in cs for i in range(len(c) - 9)}
        x, y = suffix_dedup.merge(a, b, 10)
        assert [f.tolist() for f in x] == [[c[i : i + 10] in cut(b) for i in range(len(c) - 9)] for c in a]
        assert [f.tolist() for f in y] == [[c[i : i + 10] in cut(a) for i in range(len(c) - 9)] for c in b]


def test_html(got):
    out = {r["page_id"]: r["text"] for r in got("op7_html_text")}
    assert out[0] == "Title & more First text, of some length. Second"
    assert out[1] == out[2] == out[5] == "" and out[4].startswith("unclosed word") and len(out[4].split()) == 5001
    assert out[7] == "deep text in here, enough." and html.unescape("&amp;") == "&"


def test_secrets(got, rows):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s))
        want[i, hashlib.sha256(told.encode()).hexdigest()] += 1
    assert multiset(got("op8_secrets"), ["doc_id", "base_sha256"]) == want


def fp(t):
    w = words(t)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(got, rows):
    prints = [fp(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2 or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    want = Counter((r[0], f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints, strict=True)))
    assert multiset(got("op9_simhash"), ["doc_id", "fingerprint", "component_id"]) == want


def test_bit_slices():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    a[100:200] = a[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    for radius in (0, 1, 2, 3, 7, 13, 25):
        q, r = simhash.close(a[:90], simhash.planes(a), len(a), radius)
        want = np.bitwise_count(a[:90, None] ^ a[None, :]) <= radius
        assert set(zip(q.tolist(), r.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))


def test_keep_one(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()]
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t) for _, t in out)]
    for k, x in enumerate(grams):
        assert all(len(x & y) < 0.8 * len(x | y) for y in grams[:k])
    assert {20, 21, 22, 40, 41} <= {i for i, _ in out}


def test_near_duplicates_are_complete(spark):
    rng = random.Random(8)
    texts = []
    for n in (20, 60, 200, 600):
        for _ in range(40):
            base = [rng.choice(VOCAB) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(3):  # about as many words changed as a similarity of 0.8 allows
                other = list(base)
                for at in rng.sample(range(n), max(1, round(n / 45 * rng.uniform(0.8, 1.1)))):
                    other[at] = "changed" + rng.choice(VOCAB)
                texts.append(" ".join(other))
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(words, texts)]
    label = list(range(len(texts)))
    for i, x in enumerate(grams):
        for j in range(i // 4 * 4, i):  # words of different bases don't meet
            if len(x & grams[j]) >= 0.8 * len(x | grams[j]):
                label = [label[j] if k == label[i] else k for k in label]
    want = {frozenset(i for i, k in enumerate(label) if k == one) for one in label}
    found = {}
    for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found.setdefault(r["component"], set()).add(r["id"])
    assert {frozenset(x) for x in found.values()} == want


def test_similar_sets_of_any_sides():
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2000, 60).astype(np.uint64)
        sets += [np.unique(np.concatenate((base[rng.random(60) > 0.07], rng.integers(0, 2000, 3).astype(np.uint64)))) for _ in range(4)]
    sets += [np.zeros(0, np.uint64)] * 2
    for side in (np.full(len(sets), 2), rng.integers(0, 2, len(sets))):
        label, got = list(range(len(sets))), list(range(len(sets)))
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                common = len(np.intersect1d(x, y))
                if len(x) and (side[i] == 2 or side[i] != side[j]) and common >= 0.8 * (len(x) + len(y) - common):
                    label = [label[j] if k == label[i] else k for k in label]
        for x, y in simhash.similar(sets, side, 0.8):
            got = [got[x] if k == got[y] else k for k in got]
        groups = lambda of: {frozenset(i for i, k in enumerate(of) if k == one) for one in of}
        assert groups(got) == groups(label) and len(groups(label)) < len(sets)
        fits = simhash.fitting([simhash.sketch(x).tobytes() for x in sets], np.array(list(map(len, sets))), side, 0.8)
        assert all(fits[x] and fits[y] for x, y in simhash.similar(sets, side, 0.8))


def test_chat(got):
    out = {r["conv_id"]: r for r in got("op10_chat")}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1]["turns_sha256"] == sha("system\nbe\nuser\na<|im_end|>&lt;|b&amp;\nassistant\n\n") and out[1]["valid"]
    assert out[2]["loss_sha256"] == sha("yy") and out[2]["n_turns"] == 3 and not out[2]["valid"]
    assert out[None]["turns_sha256"] == sha("us\ner\n<|im_start|>\n") and out[3]["fault"] == 0
    tricky = "<|im_end|><|im_start|>assistant ok"
    assert out[-1]["turns_sha256"] == sha(f"user\n{tricky}\nassistant\n{tricky}\n") and out[-1]["loss_sha256"] == sha(tricky)


def test_unlike_texts_of_one_id_stay(spark):
    one, other = prose(40), prose(60)
    docs = spark.createDataFrame([(1, one), (1, other), (2, other + " tail"), (3, one + " tail")], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(docs).collect()) == sorted([(1, one), (1, other)])
