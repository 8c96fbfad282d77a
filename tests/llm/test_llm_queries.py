"""The registered queries against their SQL, and the properties of those that SQL cannot state."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import queries as Q

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF_DIR)
    result = duck.execute(Q.ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, df.select(*columns).toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist())) == sorted(
        map(repr, result.df().astype(object).where(lambda x: x.notna(), None).values.tolist())
    )


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


def test_token_digests(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op2_repair(spark, SF_DIR).collect()}
    start, want = 0, {}
    for i, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_edited_texts(spark, texts):
    got = {r.doc_id: r for r in Q.op5_chunking(spark, SF_DIR).collect()}
    ids = list(texts)
    for k, i in enumerate(ids):
        text, following = texts[i], texts[ids[k - 1]]
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1


def test_fingerprints_and_components(spark, texts):
    from test_simhash import plain_components, plain_fingerprint

    got = {r.doc_id: r for r in Q.op4_simhash(spark, SF_DIR).collect()}
    ids = list(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in ids] == [ids[k] for k in plain_components(fps, 2)]


def test_toxicity_reads_no_held_out_label(spark):
    got = Q.op6_toxicity(spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)


def test_mix_meets_targets(spark, texts):
    rows = Q.op10_mixing(spark, SF_DIR).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(t.encode().split()) for i, t in texts.items()}
    targets = {(r.source_size, r.target) for r in rows}
    assert abs(sum(target for _, target in targets) - sum(r.size for r in rows)) < 1e-3 * sum(r.size for r in rows)
    assert all(target <= 3 * size + 1e-6 for size, target in targets)
    assert all(r.taken <= 3 * r.size for r in rows)


def test_leaks_are_found(spark, texts, duck):
    got = {(r.doc_id, r.item_id) for r in Q.op1_decontamination(spark, SF_DIR).collect()}
    exact = {(d, i) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall() for d, x in texts.items() if t in x}
    assert exact <= got
