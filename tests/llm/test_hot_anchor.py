"""op6_suffix_dedup where one anchor has many contexts: a common line or passage in texts that differ around it."""

import hashlib

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from metrigraph.llm import suffix_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        out.append((len(t), int(cover.sum()), int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts(rng, n):
    """A line of 60 letters, or a passage of 390, in unlike texts; some share more around it, some are copies."""
    word = lambda k: "".join(chr(97 + c) for c in rng.integers(0, 26, k))
    line, passage, near, far = word(60), word(390), word(250), word(250)
    out = []
    for i in range(n):
        mid = passage if i % 3 == 0 else line
        left = word(300) if i % 4 else word(40) + near[int(rng.integers(0, 200)) :]
        right = word(300) if i % 5 else far[: int(rng.integers(0, 250))] + word(60)
        out.append(left + mid + right)
    return [*out, *out[:7], None, "", line, "é" * 300 + line, "é" * 300 + line]


@pytest.mark.parametrize(("hot", "chunk", "paired"), [(256, 2048, 8), (8, 2048, 8), (8, 4, 100), (8, 4, 3)])
def test_hot_anchor_is_exact(spark, monkeypatch, hot, chunk, paired):
    for name, value in (("HOT", hot), ("CHUNK", chunk), ("PAIRED", paired)):
        monkeypatch.setattr(suffix_dedup, name, value)
    data = texts(np.random.default_rng(6), 120)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sorted(got)] == brute(data, 400)


def test_contexts_of_a_common_passage_are_not_paired(spark, monkeypatch):
    """Rows dealt to shards grew with the square of a common passage's contexts, though no string of them repeats."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 16)
    monkeypatch.setattr(suffix_dedup, "HOT", 8, raising=False)
    rng, dealt, plain = np.random.default_rng(8), [], DataFrame.repartition
    word = lambda k: "".join(chr(97 + c) for c in rng.integers(0, 26, k))

    def spy(self, *args):
        if "task" in args:
            dealt.append(self.count())
        return plain(self, *args)

    monkeypatch.setattr(DataFrame, "repartition", spy)
    passage = word(300)
    docs = spark.createDataFrame([(word(380) + passage + word(380),) for _ in range(400)], "text string")
    assert suffix_dedup.repeated_spans(docs).count() == 0
    assert len(dealt) == 1 and dealt[0] <= 800
