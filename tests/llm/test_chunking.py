"""Chunks against a byte-by-byte version, shift resistance, and neighbours against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chunking as C


def slow_boundaries(data):
    ends, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (h << 1) + int(C.gear()[b]) & 0xFFFFFFFF
        size = i + 1 - start
        bits = C.HARD if size < C.USUAL else C.EASY
        if size >= C.LEAST and h >> (32 - bits) == 0 or size == C.MOST:
            ends.append(i + 1)
            start = i + 1
    return ends + [len(data)] * (start < len(data))


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghiö", k=rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("span", [100, 1 << 20])
def test_boundaries_match_the_rolling_hash(span, monkeypatch):
    monkeypatch.setattr(C, "SPAN", span)
    for text in (prose(2000, 1), "ab " * 900, "", "x", prose(5, 2)):
        assert C.boundaries(text.encode()) == slow_boundaries(text.encode())


def test_containment_resists_shifts():
    a = prose(1500, 3)
    w = C.chunk_weights(a)
    assert C.containment(w, C.chunk_weights("new start " + a)) > 0.95
    assert 0.45 < C.containment(w, C.chunk_weights(a[: len(a) // 2] + prose(700, 4))) < 0.55
    assert C.containment(w, C.chunk_weights(prose(1500, 5))) < 0.02
    assert C.containment({}, {}) == 1 and C.containment({}, w) == C.containment(w, {}) == 0
    assert C.from_text(C.as_text(w)) == w
    assert sum(w.values()) == len(a.encode())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_each_document_against_the_next(spark, parts):
    rng = random.Random(6)
    rows = [(i, prose(rng.randint(0, 90), i)) for i in rng.sample(range(1000), 60)]
    rows += [(7001, None), (7002, ""), (7003, "x"), (7002, ""), (7003, "long " * 30_000), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("section", F.lit("a")).withColumn("guest", F.lit(1))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in C.compared_with_next(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(((i is not None, i or 0, t or ""), i) for i, t in rows)
    want = []
    for k, ((_, _, text), i) in enumerate(order):
        following = order[k - 1][0][2]
        changed = C.edited(text, following)
        w, e, f = map(C.chunk_weights, (text, changed, following))
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), C.as_text(w), C.as_text(e), C.containment(w, e), C.containment(w, f)))
    key = repr
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert C.compared_with_next(none).count() == C.fingerprints(none).count() == 0
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    r = C.compared_with_next(one).first()
    assert (r.near_next, r.edited_sha256) == (1.0, hashlib.sha256(b"abcdab").hexdigest())
    assert C.fingerprints(one).first().fingerprint == r.fingerprint
