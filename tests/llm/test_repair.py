"""Round trips of shards, documents and ids against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import repair as R

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The cat's hat sat; the cat's hat sat.", "", None, " \n\t", "naïve Café café İI ſ ß", "a b c\x1cd\x85e", "<|endoftext|> don't 1234",
    "a <|endoftext|> b", "a<|endoftext|>b <|startoftext|><|startoftext|>, x <|EndOfText|> <|endoftext |> |>",
    "ΣΑΣ ΑΣ ΑΣ. ς σ Éé é é.. ŒUVRE, ß! x's 'tis it's, can't. don'T a-b a_b a1b ªº ʰa Ⅷ ²",
    "日本語 テキスト 🎉🎉 x", "the the the the the the the", "Word " * 40_000, "́start ́ end",
]


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_special_tokens_are_no_simple_words():
    special = [t.content for t in Tokenizer.from_file(PATH).get_added_tokens_decoder().values()]
    assert special and not any(set(s) & set(" \t\n\v\f\r") for s in special)
    assert all(R.simple_runs(a + s + b) is None for s in special for a in ("", "a") for b in ("", "b", "."))


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_read_back_equals_the_tokenizer(spark, size):
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    df = df.withColumn("shard", F.lit("x")).withColumn("start", F.lit(1))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in R.written_and_read(df, PATH, size=size, least=2).collect()}
    start, want = 0, {}
    for i, ids in enumerate(plain(TEXTS)):
        want[i * 3] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_words_of_all_tables_are_encoded_as_the_tokenizer_does():
    import duckdb

    texts = [r[0] for r in duckdb.execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    assert [ids.tolist() + [1] for ids in R.encoded(PATH, pa.array(texts))] == plain(texts)


def test_random_access_and_rules(spark):
    df = spark.createDataFrame([(i, (t or "") + " over and over and over again") for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = [r.asDict() for r in R.shards(df.coalesce(1), PATH, least=2).collect()]
    want = dict(enumerate(plain([(t or "") + " over and over and over again" for t in TEXTS])))
    for row in rows:
        alphabet, rules, lengths = R.grammar(row)
        assert (rules < len(alphabet) + np.arange(len(rules))[:, None]).all()  # a rule uses what was made before
        assert all(len(R.expanded(np.array([len(alphabet) + r]), alphabet, rules, lengths)) == n for r, n in enumerate(lengths[:50]))
        for k, doc_id in enumerate(np.frombuffer(row["doc_ids"], "<i8").tolist()):
            assert R.document_ids(row, k).tolist() == want[doc_id]
    assert sum(r["n_symbols"] for r in rows) < sum(r["n_tokens"] for r in rows) / 4


@pytest.mark.parametrize("terminals", [6, 70_000])
def test_no_frequent_pair_is_left_and_none_crosses_a_document(terminals):
    rng = np.random.default_rng(2)
    ids = rng.choice(6, 5000, p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05]) + terminals - 6
    ends = np.zeros(len(ids), bool)
    ends[99::100] = True
    symbols, rules, counts = R.compressed(ids, ends, terminals, 4, 0.3)
    grammar = np.arange(terminals, dtype=np.uint32), rules, R.rule_lengths(rules, terminals)
    assert (R.expanded(symbols, *grammar) == ids).all()
    assert counts.sum() == len(symbols) and len(counts) == 50
    documents = np.split(symbols, np.cumsum(counts)[:-1])
    assert all(len(R.expanded(s, *grammar)) == 100 for s in documents)
    pairs = {}
    for s in documents:
        for pair in zip(s[:-1].tolist(), s[1:].tolist()):
            pairs[pair] = pairs.get(pair, 0) + 1
    assert max(pairs.values()) < 4


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.written_and_read(none, PATH).count() == 0
    twice = spark.createDataFrame([(None, "b"), (1, "same"), (1, "same"), (None, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id) for r in R.written_and_read(twice, PATH).collect())
    assert [g[1] for g in got] == [None, None, 1, 1]
    assert got[0][0] == 0


def test_words_in_use_are_encoded_once_however_many_others_come(monkeypatch):
    monkeypatch.setattr(R, "REMEMBERED", 100)
    R.encoder.cache_clear()
    seen, plainly = [], R.word_ids
    monkeypatch.setattr(R, "word_ids", lambda path, words: seen.extend(words) or plainly(path, words))
    often = [f"often{i}" for i in range(20)]
    for k in range(8):
        texts = [" ".join([*often, *(f"w{k}x{i}" for i in range(150))]), "", "Often0 often1."]
        assert [ids.tolist() + [1] for ids in R.encoded(PATH, pa.array(texts))] == plain(texts)
    R.encoder.cache_clear()
    assert all(seen.count(w) == 1 for w in often)


def test_parts_hold_all_rows_in_order_within_both_bounds(monkeypatch):
    monkeypatch.setattr(R, "TOGETHER", 4)
    monkeypatch.setattr(R, "TOGETHER_BYTES", 10)
    texts = ["a" * n for n in (1, 1, 1, 1, 1, 30, 0, 9, 1, 1, 0, 0)]
    parts = [p.column("text").to_pylist() for p in R.parts_of(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))]
    assert sum(parts, []) == texts
    assert all(len(p) == 1 or len(p) <= 4 and len("".join(p)) <= 10 for p in parts) and len(parts) == 5
