"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items, k):
    """Every score of every document, in Python's whole numbers."""
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        query, scores = Counter(plain_terms(text)), []
        for i, c, n in counted:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in query.items()
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item_id, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def invented(n, seed, words=40):
    rng = np.random.default_rng(seed)
    names = [f"w{j}" for j in range(words)]
    weights = 1 / np.arange(1, words + 1)
    return [(i, " ".join(rng.choice(names, rng.integers(1, 60), p=weights / weights.sum()))) for i in range(n)]


def found(spark, docs, items, k=20, parts=3):
    rows = R.ranked(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), k).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("k", [1, 5, 20])
def test_ranks_equal_scoring_everything(spark, k):
    docs, items = invented(400, 1), [(10 + i, t) for i, t in invented(12, 2)]
    assert found(spark, docs, items, k) == sorted(plain_ranks(docs, items, k), key=str)


def test_ties_copies_nulls_and_long_texts(spark):
    docs = [(i, "Alpha BETA, gamma") for i in range(40, 0, -1)] + [(i, "alpha-alpha") for i in (50, 50, 51)]
    docs += [(None, "alpha beta gamma"), (60, None), (61, ""), (62, " .,;"), (63, "gamma " * 30_000 + "Été alpha"), (64, "ÉTÉ")]
    items = [(1, "alpha"), (2, "beta BETA gamma"), (3, "nothing here"), (4, None), (5, "Été"), (1, "alpha"), (None, "gamma")]
    want = plain_ranks(docs, [(1, "alpha"), (2, "beta BETA gamma"), (5, "Été"), (None, "gamma")], 20)
    assert found(spark, docs, items) == sorted(want, key=str)
    assert [r[2] for r in want if r[0] == 2] == list(range(1, 21))


def test_small_shards_and_clashing_columns(spark, monkeypatch):
    docs, items = invented(150, 3), [(i, t) for i, t in invented(5, 4)]
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in ("n", "terms", "rank", "score", "item_id", "query", "part")})
    asked = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit("x") for c in ("doc_id", "n", "rank")})
    monkeypatch.setattr(R, "MERGED", 1)
    rows = sorted((tuple(r) for r in R.ranked(frame.repartition(7), asked, 4).collect()), key=str)
    assert rows == sorted(plain_ranks(docs, items, 4), key=str)


def test_batches_make_shards_of_bounded_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(R, "SHARD_POSTINGS", 10)
    codes = {f"w{i}".encode(): i for i in range(40)}
    docs = invented(30, 5)
    batch = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t}]) for i, t in docs]
    postings = list(R.posting_batches(iter(batch), codes))
    out = list(R.search_batches(iter(postings), [[(0, 7)]], 30, 900, 3))
    assert 1 < len(out) <= 30 and all(b.num_rows <= 3 for b in out)


def test_bounds_close_only_when_exact():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n, q, k = int(rng.integers(1, 300)), int(rng.integers(1, 6)), int(rng.integers(1, 12))
        table = rng.integers(0, 5, (n, q)) * (rng.random((n, q)) < 0.6)
        lists = []
        for i in range(q):
            docs = np.flatnonzero(table[:, i])
            docs = docs[np.argsort(-table[docs, i], kind="stable")]
            lists.append((docs, table[docs, i]))
        docs, scores = R.best(lists, n, k)
        total = table.sum(1)
        assert (scores == total[docs]).all()
        limit = max(1, sorted(total, reverse=True)[min(k, n) - 1]) if n >= k else 1
        assert sorted(docs) == np.flatnonzero(total >= limit).tolist()


def test_empty_tables(spark):
    docs, items = [(1, "alpha")], [(1, "alpha")]
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
