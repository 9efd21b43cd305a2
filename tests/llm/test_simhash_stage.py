"""The near-duplicate stage joins texts by fingerprints, and prefixes complete it."""

import random

from metrigraph.llm import simhash

RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(5000)]


def groups(spark, texts):
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["component"], set()).add(r["id"])
    return {frozenset(x) for x in by.values()}


def test_fingerprints_join_near_copies(spark, monkeypatch):
    """Without the prefixes' links, copies with one word changed are still found; unlike texts stay apart."""
    base = [[RNG.choice(WORDS) for _ in range(2000)] for _ in range(5)]
    texts = [" ".join(x) for x in base] + [" ".join([*x[:1000], "changed", *x[1001:]]) for x in base]
    want = {frozenset((i, i + 5)) for i in range(5)}
    assert groups(spark, texts) == want
    monkeypatch.setattr(simhash, "_linked", lambda df, *_: df.sparkSession.createDataFrame([], "u long, v long"))
    assert groups(spark, texts) == want


def test_prefixes_find_what_fingerprints_miss(spark):
    """Short texts of similarity 0.8 to 0.9 differ in more bits than fingerprints are joined by."""
    base = [[RNG.choice(WORDS) for _ in range(100)] for _ in range(20)]
    texts = [" ".join(x) for x in base] + [" ".join([*x[:50], "changed", *x[51:]]) for x in base]
    bits = [(simhash.fingerprint(simhash.shingle_hashes(texts[i].encode(), 5)) ^ simhash.fingerprint(simhash.shingle_hashes(texts[i + 20].encode(), 5))) & (1 << 64) - 1 for i in range(20)]
    assert any(b.bit_count() > simhash.NEAR_BITS for b in bits)
    assert groups(spark, texts) == {frozenset((i, i + 20)) for i in range(20)}
