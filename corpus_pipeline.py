"""A training-data pipeline over the documents table: each stage takes all rows that the stage before kept.

toxicity            documents scored as toxic go
near_duplicates     one document of every near-duplicate group stays
decontamination     documents that hold a benchmark item go
mixing              documents are repeated or left out until sources meet their target words
tokens              documents become Re-Pair compressed token shards
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, mixing, repair, simhash, toxicity
from tallyforge.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.5 or more. The model is fitted on these documents and ``labels``. Null and
    empty texts are scored like any other; repeated rows share their fate."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group, five-word shingles at least 0.8 alike, the row with the smallest doc_id. Blank texts are one group."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark`` within its edit budget."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; blank documents are taken once."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written shards, one row each (see ``repair``). Every copy of a document is encoded."""
    return stored(repair.shards(docs, public_tokenizers.path("word_bpe_49k.json")), "pipeline-shards")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_near_duplicate),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: the classifier and the tokenizer cannot be stated in SQL; tests/llm/test_pipeline.py has a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again, so a lost executor costs one stage at
    most. Returns a row for each token shard: its documents, tokens, symbols and a digest of its bytes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    shards = STAGES[-1][1](spark, docs, sf_dir)
    return shards.select(
        "shard", "n_docs", "n_tokens", "n_symbols", F.sha2(F.concat("doc_ids", "rules", "symbols"), 256).alias("sha256")
    )
