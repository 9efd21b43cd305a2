"""The pipeline stage by stage against brute force, on awkward rows with clashing column names."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from metrigraph.llm import quality

RNG = random.Random(21)
VOCAB = ["".join(RNG.choice("abcdefghijkl") for _ in range(RNG.randint(2, 9))) for _ in range(900)]
prose = lambda n: " ".join(RNG.choice(VOCAB) for _ in range(n))
ITEMS = [prose(25) for _ in range(6)]
CLASH = ("_i", "_k", "_key", "_go", "_score", "_before", "_spans", "key", "own", "hit", "text_", "size", "h", "mix_size")
FIELDS = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in CLASH]]
STAGES = dict(corpus_pipeline.STAGES)


def corpus():
    texts = [None, "", " ", "one", prose(4000), prose(120), prose(120)]
    texts += [prose(RNG.randint(20, 150)) for _ in range(60)]
    texts += [texts[20], texts[21].upper(), texts[22] + " tail", " ".join([texts[23], "a", "b"])]
    texts += [f"{prose(30)} {x} {prose(30)}" for x in ITEMS]
    texts += [f"{prose(20)} password = hunter2hunter2 {prose(20)}", f"{prose(20)} {'0123456789abcdef' * 2} {prose(9)}"]
    texts += [" ".join(w for w in RNG.choices(VOCAB, k=12) for _ in range(9)) for _ in range(25)]  # each word again and again
    rows = [(i, t, "en", RNG.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], (None, "an unnamed text of its own", None, None, None), (None, None, None, None, None), (40, prose(50), "en", "a", 1)]
    return rows


def junk(t):
    ws = (t or "").split()
    return len(set(ws)) * 5 < len(ws)


def tables(folder, rows):
    folder.mkdir()
    pq.write_table(pa.table({n: pa.array([(*r, *([f"clash{k}"] * len(CLASH)))[k2] for k, r in enumerate(rows)], t) for k2, (n, t) in enumerate(FIELDS)}), folder / "documents.parquet")
    labels = [(r[0], 0 if junk(r[1]) else 1) for r in rows if r[0] is not None] + [(10**6, 1), (3, None)]
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), folder / "labels.parquet")
    items = [*ITEMS, None, ""] if rows else []
    pq.write_table(pa.table({"item_id": pa.array(range(len(items)), pa.int64()), "text": pa.array(items, pa.string())}), folder / "benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def sf(tmp_path_factory, rows):
    return tables(tmp_path_factory.mktemp("pipeline") / "sf", rows)


def run(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = STAGES[name](spark, docs, sf)
    if name != "mixing":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    return [r.asDict() for r in out.collect()], [r.asDict() for r in docs.collect()]


def pairs(found):
    return Counter((r["doc_id"], r["text"], r["_key"]) for r in found)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]


def test_quality_stage(spark, sf):
    out, docs = run(spark, sf, "quality")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    score = quality.Scorer(model)
    kept = [d for d in docs if score(pa.array([d["text"]], pa.string()))[0] >= 0]
    assert pairs(out) == pairs(kept)
    assert sum(junk(r["text"]) and len((r["text"] or "").split()) > 20 for r in out) == 0
    assert all(r in out for r in docs if not junk(r["text"]) and len((r["text"] or "").split()) > 20)


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_stage(spark, sf):
    out, docs = run(spark, sf, "near_duplicates")
    sets = [grams(d["text"]) for d in docs]
    label = list(range(len(docs)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or x and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                label = [label[j] if k == label[i] else k for k in label]
    order = lambda d: (d["doc_id"] is None, d["doc_id"] or 0)
    want = Counter()
    for one in set(label):
        want[min((d for d, k in zip(docs, label, strict=True) if k == one), key=order)["doc_id"]] += 1
    assert Counter(r["doc_id"] for r in out) == want
    assert all(any(r == d for d in docs) for r in out)  # whole rows, clashing columns included


def test_decontamination_stage(spark, sf):
    out, docs = run(spark, sf, "decontamination")
    assert pairs(out) == pairs([d for d in docs if not any(x in (d["text"] or "") for x in ITEMS)])


def test_secrets_stage(spark, sf):
    out, docs = run(spark, sf, "secrets")

    def want(t):
        return None if t is None else t.replace("password = hunter2hunter2", "[secret]").replace("0123456789abcdef" * 2, "[secret]")

    assert pairs(out) == Counter((d["doc_id"], want(d["text"]), d["_key"]) for d in docs)
    was = {d["_key"]: d for d in docs}
    assert all(r["n_chars"] == (was[r["_key"]]["n_chars"] if r["text"] == was[r["_key"]]["text"] else len(r["text"])) for r in out)


def test_mixing_stage(spark, sf):
    out, docs = run(spark, sf, "mixing")
    size = lambda d: len((d["text"] or "").split())
    total = Counter()
    for d in docs:
        total[d["source"]] += size(d)
    taken = Counter()
    for r in out:
        assert r["mix_size"] == size(r) and r["mix_source_size"] == total[r["source"]] and r["mix_copies"] in (1, 2)
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
    largest = max(map(size, docs))
    assert all(abs(taken[r["source"]] - r["mix_target"]) <= largest for r in out)
    again, _ = run(spark, sf, "mixing")
    key = lambda r: (r["_key"], r["mix_copies"])
    assert Counter(map(key, again)) == Counter(map(key, out))


def test_whole_run(spark, sf, rows):
    out = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    assert out and len({(r["doc_id"], r["text"]) for r in out}) == len(out)
    texts = [r["text"] or "" for r in out]
    assert not any(x in t for x in ITEMS for t in texts) and not any("hunter2" in t for t in texts)
    assert {c for c in CLASH if c != "mix_size"} <= set(out[0])


def test_no_rows(spark, tmp_path):
    sf = tables(tmp_path / "none", [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
