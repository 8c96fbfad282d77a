"""Verdicts against a loop over all entries; the filter's false positives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries, url_filter as U

ENTRIES = "entry string, verdict string, ruled boolean"


def plain(url, entries, default="allow"):
    url = url or ""
    if "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for entry, verdict, ruled in entries:
        h, _, p = entry.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((ruled, len(entry), entry, verdict))
    if not fits:
        return host, path, None, default
    ruled, _, entry, verdict = max(fits)
    return host, path, entry if ruled else None, verdict


URLS = [
    "http://example.org/es/1", "https://a.b.Example.ORG/en/17?x#y", "http://example.org/en/2", "http://example.org/EN/1", "http://notexample.org/es/",
    "http://x.com/fr/a", "http://x.com/de/", "http://x.com/de", "http://com/fr/", "http://org", "http://org?x=/es/", "org/es/", "", None, "://", "ftp://é.ÉX.com/fr/#",
    "http://a.net/x://y.org/z", "http://www.spam-farm.example.net/q", "http://spam-farm.example.org/es/4", "http:///path", "http://.org/", "http://u@h.com:80/fr/",
]


def test_verdicts_match_a_plain_loop(spark):
    entries = [(e, v, True) for e, v in queries.RULES] + [(e, "block", False) for e in queries.LISTED]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string").withColumn("verdict", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judged(df, spark.createDataFrame(entries, ENTRIES)).collect()}
    assert got == {i: plain(u, entries) for i, u in enumerate(URLS)}
    assert U.judged(df, spark.createDataFrame(entries, ENTRIES)).count() == 2 * len(URLS)


@pytest.mark.parametrize("most", [64 << 20, 32])
def test_many_entries_even_with_a_full_filter(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MOST_BYTES", most)
    rng = random.Random(1)
    name = lambda: rng.choice("abcd") + rng.choice("xyz")
    entries = sorted({(f"{name()}.{name()}/{''.join(rng.choices('pq', k=rng.randint(0, 3)))}", rng.choice(["allow", "block"]), rng.random() < 0.5) for _ in range(150)})
    urls = [(i, f"http://{name()}.{name()}.{name()}/{''.join(rng.choices('pqr', k=4))}") for i in range(400)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judged(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(entries, ENTRIES)).collect()}
    assert got == {i: plain(u, entries) for i, u in urls}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = [f"host{i}.example/{i}" for i in range(5000)]
    words = U.built_filter(spark.createDataFrame([(k.split("/")[0], "/" + k.split("/")[1]) for k in keys], "host string, path string"))
    assert U.passes(words, keys).all()
    assert U.passes(words, [f"other{i}.example/{i}" for i in range(20_000)]).mean() < 0.01
    assert words.nbytes <= 5000 * 2 + 64 and words.dtype == np.uint32


def test_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], ENTRIES)
    assert U.judged(pages, none, "block").first().asDict() == {"page_id": None, "host": "a.org", "path": "/", "rule": None, "verdict": "block"}
    assert U.judged(pages.limit(0), none).count() == 0
