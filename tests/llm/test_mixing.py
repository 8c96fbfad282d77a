"""Targets, tilts and copies against a plain calculation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_targets(sizes):
    """Sizes by source; excess over 3 times a source's size is shared again until none is above."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * sizes[s]}
        if not over:
            out |= {s: weight[s] * share for s in open_}
            break
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def corpus(seed=1, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", "d", None, "é", "~"])
        rows.append((i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), "en", source, 0))
    rows += [(n + i, t, "en", "tiny", 0) for i, t in enumerate(["one", "one two", "", None])]
    rows += [(n + 10 + i, "copy " * 40, "en", "hot", 0) for i in range(1200)]
    return rows


def test_each_source_meets_its_target(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in M.mixed_documents(docs).collect()}
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], sizes[source[i]])
        assert r.target == pytest.approx(want[source[i]], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[source[i]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * max(size[i] for i in size if source[i] == s) + 1, s
    again = {r.doc_id: r.taken for r in M.mixed_documents(docs.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_rates_are_tilted_exponentially(spark):
    cells = [("k", s, 10) for s in (1, 2, 5, 9, 30)]
    goal = 900.0
    df = spark.createDataFrame(cells, "source string, size long, n long")
    goals = spark.createDataFrame([("k", 470, goal, 50)], "source string, source_size long, target double, docs long")
    tilt = M.solved_rates(df, goals).first().tilt
    assert sum(n * s * min(3, math.exp(tilt * s)) for _, s, n in cells) == pytest.approx(goal, rel=1e-8)


def test_odd_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert M.mixed_documents(docs).count() == M.mixture(docs).count() == 0
    rows = [(None, None, None, None, None), (1, "", None, None, None), (2, "a b", None, "s", None), (2, "a b", None, "s", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).withColumn("size", F.lit("x")).withColumn("copies", F.lit(0))
    out = M.mixture(docs)
    assert out.columns == docs.columns
    assert out.where("text = 'a b'").count() == 2
    assert sorted((r.doc_id or -1, r.taken) for r in M.mixed_documents(docs).collect()) == [(-1, 0), (1, 0), (2, 2), (2, 2)]


def test_mixture_repeats_documents(spark):
    docs = spark.createDataFrame(corpus(2, 400), DOCS)
    counts = {r.doc_id: r["count"] for r in M.mixture(docs).groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in M.mixed_documents(docs).collect() if r.copies}
