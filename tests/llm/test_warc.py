"""Round trips through archives, against hashes and groups in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import warc as W

PAGES = "page_id long, url string, html string"


def pages():
    rng = random.Random(1)
    big = "é" * 1200
    rows = [(i, f"http://h.example/{i}", "".join(rng.choices("abc<>é\r\n", k=rng.choice([0, 5, 999, 1000, 5000])))) for i in range(60)]
    rows += [(100 + i, f"http://c.example/{i}", big) for i in range(300)]
    rows += [(500, None, "short"), (501, "http://x.example/a b\r\nX: y", "short"), (502, "u", None), (503, "u", ""), (504, "u", "x" * 3_000_000)]
    rows += [(505, "u", "y" * 1500), (505, "u", "y" * 1500), (506, "u", "z" * 999), (507, "u", "z" * 999)]
    rows += [(None, "u", big), (None, "u", "null pages only " * 100), (None, "u", "null pages only " * 100)]
    return rows


def expected(rows):
    groups = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            groups[data] = max(i, groups.get(data, -1))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = groups.get(data)
        revisit = keeper is not None and keeper != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,archive", [(1 << 20, 1 << 30), (700, 4000)])
def test_read_back(spark, monkeypatch, chunk, archive):
    monkeypatch.setattr(W, "CHUNK", chunk)
    monkeypatch.setattr(W, "ARCHIVE_BYTES", archive)
    df = spark.createDataFrame(pages(), PAGES).repartition(3).withColumn("digest", F.lit("x")).withColumn("bytes", F.lit(1))
    assert sorted(map(tuple, W.written_and_read(df).collect()), key=repr) == expected(pages())


def test_payloads_come_back_in_chunks(spark):
    rows = [(1, "http://a.example/%20x y", "ab\r\n\r\nWARC/1.1\r\n" * 1000), (2, "http://b.example/", "")]
    root, archives = W.write(spark.createDataFrame(rows, PAGES))
    got = W.read(root, archives, chunk=1000).orderBy("page_id", "chunk").collect()
    one = [r for r in got if r.page_id == 1]
    data = rows[0][2].encode()
    assert b"".join(r.data for r in one) == data
    assert [r.so_far for r in one] == [*range(1000, len(data), 1000), len(data)]
    assert all(r.digest_so_far == hashlib.sha1(data[: r.so_far]).hexdigest() for r in one)
    assert [r.last for r in one] == [False] * (len(one) - 1) + [True]
    assert one[0].url == "http://a.example/%20x%20y"
    assert [(r.size, r.last) for r in got if r.page_id == 2] == [(0, True)]
    assert archives.agg(F.sum("records")).first()[0] == 2


def test_no_pages(spark):
    assert W.written_and_read(spark.createDataFrame([], PAGES)).count() == 0
