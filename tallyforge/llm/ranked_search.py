"""Ranked lexical search without random access.

Documents become posting shards, each holding, for every term, its documents by falling impact. The search of a shard
reads the lists of a query side by side from the top. What a document has shown so far is its lower bound; adding, for each list it
has not been met in, the impact that list would yield next gives its upper bound. Reading ends when no document outside the best k, met or
not, can reach the k-th lower bound any more, and bounds of all that can have met. So members, ties and scores are exact.
The best of all shards, ranked again, are the best of all documents.

Scores are whole numbers, see ``impacts``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import stored, whole_text

#: postings that a task holds at once; a shard is as many whole documents
SHARD_POSTINGS = 4_000_000
#: characters of query texts that one pass over the documents searches for
BLOCK_CHARS = 4_000_000
#: postings read of each list before bounds are compared first; then four times as many
FIRST_READ = 64
#: partitions whose results are ranked together before all are
MERGED = 64

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "query int, doc_id long, score long"

# Separators are ASCII characters that are no letter or digit; A-Z become lower case.
LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c
    for c in range(256)
)


def terms_in(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split()


# --- postings ---


def posting_batches(batches: Iterator[pa.RecordBatch], codes: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Of each document with a term: its length and how often it holds each term of the queries."""
    for batch in batches:
        ids, sizes, terms, counts = [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = terms_in(text.as_py())
            if words:
                known = {codes[w]: c for w, c in Counter(words).items() if w in codes}
                ids.append(doc_id)
                sizes.append(len(words))
                terms.append(list(known))
                counts.append(list(known.values()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            ["doc_id", "n", "terms", "counts"],
        )


def term_weights(postings: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """The weight of each term of the queries, the number of documents with a term and of all terms in them."""
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(size, np.int64)
    # one row for each term of a block of queries
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
        weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    return weights, n_docs, n_terms


# --- one shard ---


def impacts(counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds for each unit of its weight: counts saturate, and weigh less in documents above the mean length."""
    length = 75 + 25 * sizes * n_docs // n_terms
    return 1_000_000_000 * counts // (1000 * counts + 12 * length)


def best(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents that can be among the k best, ties with the k-th included, and their exact scores.

    Each list is (documents, impacts) by falling impact, a document at most once in a list.
    """
    lower = np.zeros(n_docs, np.int64)
    unseen = np.ones((n_docs, len(lists)), bool)
    at, step, candidates, closed = 0, FIRST_READ, None, False
    while True:
        for i, (docs, values) in enumerate(lists):
            met = docs[at : at + step]
            lower[met] += values[at : at + step]
            unseen[met, i] = False
        at, step = at + step, step * 4
        ahead = np.array([values[at] if at < values.size else 0 for _, values in lists], np.int64)
        if not closed:
            candidates = np.flatnonzero(lower)
        low = lower[candidates]
        limit = max(1, int(np.partition(low, low.size - k)[low.size - k])) if low.size >= k else 1
        closed = ahead.sum() < limit
        high = low + unseen[candidates] @ ahead
        able = high >= limit
        candidates = candidates[able]
        if closed and (high[able] == low[able]).all():
            return candidates, low[able]


class Shard:
    """Postings of some documents: for each term a slice of documents and impacts, by falling impact."""

    def __init__(self, ids: list, sizes: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        values = impacts(counts.astype(np.int64), sizes[docs], n_docs, n_terms)
        order = np.lexsort((-values, terms))
        self.docs, self.values = docs[order], values[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], terms.size)
        self.place = {t: i for i, t in enumerate(self.terms.tolist())}

    def search(self, query: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """(doc_id, score) of the k best documents; the query is (term, weight with repeats)."""
        lists = []
        for term, weight in query:
            i = self.place.get(term)
            if i is not None and weight > 0:
                s = slice(self.starts[i], self.ends[i])
                lists.append((self.docs[s], self.values[s] * weight))
        if not lists:
            return []
        found, scores = best(lists, len(self.ids), k)
        rows = sorted(((-s, self.ids[d] is None, self.ids[d] or 0, d) for d, s in zip(found.tolist(), scores.tolist())))
        return [(self.ids[d], -s) for s, _, _, d in rows[:k]]


def search_batches(
    batches: Iterator[pa.RecordBatch], queries: list[list[tuple[int, int]]], n_docs: int, n_terms: int, k: int
) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def results() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
        shard = Shard(
            table.column("doc_id").to_pylist(), table.column("n").to_numpy(), terms.value_lengths().to_numpy(),
            terms.flatten().to_numpy(), counts.flatten().to_numpy(), n_docs, n_terms,
        )
        rows = [(i, d, s) for i, query in enumerate(queries) for d, s in shard.search(query, k)]
        columns = list(zip(*rows)) if rows else [[]] * 3
        kinds = (pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query", "doc_id", "score"])

    for batch in batches:
        held.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= SHARD_POSTINGS:
            yield results()
            held, size = [], 0
    if size:
        yield results()


# --- all documents ---


def query_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct queries in blocks of bounded size, which travel with the plan."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).distinct().orderBy("item_id", "text")
    block, held = [], 0
    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text))
        held += len(r.text)
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def ranked_block(texts: DataFrame, block: list[tuple[int | None, str]], k: int) -> DataFrame:
    queries = [Counter(terms_in(text)) for _, text in block]
    codes = {t: i for i, t in enumerate(sorted(set().union(*queries)))}
    postings = stored(texts.mapInArrow(partial(posting_batches, codes=codes), POSTINGS), "postings")
    weights, n_docs, n_terms = term_weights(postings, len(codes))
    weighted = [[(codes[t], c * int(weights[codes[t]])) for t, c in q.items()] for q in queries]
    found = postings.mapInArrow(partial(search_batches, queries=weighted, n_docs=n_docs, n_terms=n_terms, k=k), FOUND)
    found = found.withColumn("part", F.floor(F.spark_partition_id() / MERGED))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["query", "part"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = F.create_map(*[F.lit(x) for i, (item_id, _) in enumerate(block) if item_id is not None for x in (i, item_id)])
    item = names[F.col("query")] if any(i is not None for i, _ in block) else F.lit(None)
    return found.select(item.cast("long").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item, equal scores by
    ascending doc_id.

    The items are the stated query set; they go to the tasks in blocks of at most ``BLOCK_CHARS`` characters. For each block, documents are read once
    and leave a written table of the block's postings, whose shards are searched; only k rows of a shard and
    item are shuffled. A shard holds at most ``SHARD_POSTINGS`` postings besides those of its last batch, so memory does not follow the
    size of a partition, and a term that all documents hold is spread over all shards. Whole texts count, however long.

    Null and empty texts have no terms: such documents are neither counted nor found, such items find nothing. Every row is a document of
    its own, also where a doc_id or text is repeated; a null doc_id comes last among equals. Equal rows (item_id, text) of items
    are one query, different texts under one item_id are ranked each for itself. Other columns are not read. Empty tables
    give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    blocks = [ranked_block(texts, block, k) for block in query_blocks(items)]
    result = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if not blocks else blocks[0]
    for block in blocks[1:]:
        result = result.unionByName(block)
    return result
