"""Repeated runs of lines, found by winnowing over line hashes.

The unit is a gram: the shortest run of consecutive lines with at least ``GRAM_WORDS`` words. In every shortest run with at least
``RUN_WORDS`` words the gram with the smallest hash is a fingerprint, so two texts that share such a run share a fingerprint at the same place
of it. Each later occurrence of a fingerprint is joined with its first one and extended line by line to both sides;
what matches is deleted from the later text. An extension never needs more than ``RUN_WORDS`` words: beyond, the run has another fingerprint. So every
fingerprint carries the few line hashes around it, and no document's lines travel to another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored, whole_text

GRAM_WORDS = 25
RUN_WORDS = 50
PICKS = "doc_id long, digest string, gram long, start int, size int, before array<long>, after array<long>"


def filled_lines(text: str) -> list[tuple[int, list[str]]]:
    """(line number, words) of lines that are not blank."""
    return [(i, words) for i, line in enumerate(text.split("\n")) if (words := line.split())]


def signed_hash(data: bytes) -> int:
    h = xxhash.xxh64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def shortest_runs(words: list[int], least: int) -> list[int]:
    """For each first line the line after the shortest run with ``least`` words, or 0."""
    total = np.append(0, np.cumsum(words))
    ends = np.searchsorted(total, total[:-1] + least)
    return np.where(ends <= len(words), ends, 0).tolist()


def picks(hashes: list[int], words: list[int]) -> list[tuple[int, int, int]]:
    """(gram hash, first line, lines) of the fingerprints of a text: of every shortest run with RUN_WORDS words, the gram inside it with the
    smallest hash, the last of equals."""
    ends, runs = shortest_runs(words, GRAM_WORDS), shortest_runs(words, RUN_WORDS)
    raw = np.array(hashes, np.int64).tobytes()
    grams = [signed_hash(raw[8 * i : 8 * e]) if e else None for i, e in enumerate(ends)]
    chosen, queue, head, reach = {}, [], 0, 0
    for i, stop in enumerate(runs):
        if not stop:
            break
        while reach < len(ends) and ends[reach] and ends[reach] <= stop:  # ends never fall, so the queue's grams fit the run
            while len(queue) > head and grams[queue[-1]] >= grams[reach]:
                queue.pop()
            queue.append(reach)
            reach += 1
        while queue[head] < i:
            head += 1
        k = queue[head]
        chosen[k] = (grams[k], k, ends[k] - k)
    return list(chosen.values())


def pick_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), longs, longs]
    names = [f.split()[0] for f in PICKS.split(", ")]
    for batch in batches:
        for i in range(0, len(batch), 1024):
            rows = []
            part = batch.slice(i, 1024)
            for doc_id, digest, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "digest", "text"))):
                lines = filled_lines(text)
                words = [len(w) for _, w in lines]
                if sum(words) < RUN_WORDS:
                    continue
                hashes = [signed_hash(" ".join(w).encode()) for _, w in lines]
                right = shortest_runs(words, RUN_WORDS)
                left = shortest_runs(words[::-1], RUN_WORDS)
                n = len(words)
                for gram, start, size in picks(hashes, words):
                    end = start + size
                    stop = (right[end] or n) if end < n else n
                    first = n - (left[n - start] or n) if start else 0
                    rows.append((doc_id, digest, gram, start, size, hashes[first:start][::-1], hashes[end:stop]))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def agreeing(a: str, b: str) -> Column:
    """How many leading elements two arrays have in common."""
    differ = f"transform(arrays_zip({a}, {b}), z -> NOT (z.{a} <=> z.{b}))"
    return F.expr(f"coalesce(nullif(array_position({differ}, true), 0) - 1, size({a}))")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, first, last, of_doc, of_first): non-blank lines first..last (counted from 0) of a document repeat lines of the
    document ``of_doc`` from ``of_first`` on, which comes earlier by (doc_id, MD5 of the text, line).

    Every run of whole lines with at least 50 words that occurs again is found, in part at least: a fingerprint of it
    is, and all around it that its first occurrence shares. Shorter repeats of at least 25 words may be found too.
    Lines are compared with white space collapsed. Rows with equal doc_id and text are one document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("digest", F.md5("text"))
    found = stored(rows.select("doc_id", "digest", "text").mapInArrow(pick_batches, PICKS), "line-fingerprints")
    place = F.struct("doc_id", "digest", "start")
    first = found.groupBy("gram").agg(F.min(F.struct(place.alias("at"), F.col("before").alias("b"), F.col("after").alias("a"))).alias("f"), F.count("*").alias("n"))
    first = first.where("n > 1").select("gram", "f.*")
    later = found.join(first, "gram").where(F.struct("doc_id", "digest", "start") > F.col("at"))
    later = later.withColumn("up", agreeing("before", "b")).withColumn("down", agreeing("after", "a"))
    return later.select(
        "doc_id", "digest", (F.col("start") - F.col("up")).cast("int").alias("first"), (F.col("start") + F.col("size") + F.col("down") - 1).cast("int").alias("last"),
        F.col("at.doc_id").alias("of_doc"), (F.col("at.start") - F.col("up")).cast("int").alias("of_first"),
    ).distinct()


def without(text: str, spans: list[dict]) -> tuple[str, int, int]:
    """The text without the lines in the spans, and the numbers of lines and words deleted."""
    lines, gone, words = filled_lines(text), set(), 0
    for span in spans:
        for k in range(span["first"], span["last"] + 1):
            number, own = lines[k]
            if number not in gone:
                gone.add(number)
                words += len(own)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone), len(gone), words


def deleted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans")
        made = [without(t.as_py(), s.as_py()) if s.is_valid else (t.as_py(), 0, 0) for t, s in zip(texts, spans)]
        out, lines, words = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out, pa.string()), pa.array(lines, pa.int32()), pa.array(words, pa.int32())], ["doc_id", "text", "removed_lines", "removed_words"]
        )


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed_lines, removed_words) of every row, later repeated runs deleted (see ``repeated_runs``). The first
    occurrence stays. Null and empty texts stay empty; a text may become empty."""
    runs = repeated_runs(docs).select(F.col("doc_id").alias("i"), F.col("digest").alias("d"), F.struct("first", "last").alias("s"))
    spans = runs.groupBy("i", "d").agg(F.collect_set("s").alias("spans"))  # at most one a fingerprint of the document
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("digest", F.md5("text"))
    met = rows.join(spans, rows.doc_id.eqNullSafe(spans.i) & (rows.digest == spans.d), "left").select("doc_id", "text", "spans")
    return met.mapInArrow(deleted_batches, "doc_id long, text string, removed_lines int, removed_words int")
