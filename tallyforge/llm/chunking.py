"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes of UTF-8 decides where chunks end. Chunking is normalised: before the usual size a boundary needs more
bits of the hash to be zero, after it fewer, so most chunks have about that size. Boundaries depend on nearby
bytes only, hence return after an insertion or deletion. The fingerprint is the multiset of chunk digests
with their lengths; the containment of one text in another is the share of its bytes in chunks that the other has too.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import whole_text

LEAST, USUAL, MOST = 32, 96, 384
#: zero bits asked for before and after the usual size
HARD, EASY = 8, 5
DIGEST_BYTES = 8
#: bytes hashed at a time
SPAN = 1 << 20
#: ranges that documents are dealt to, for each shuffle partition
RANGES = 2


@cache
def gear() -> np.ndarray:
    """A fixed random number for each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 5) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: shifted left once a byte, so 32 bytes count. Windows are doubled five times."""
    h = gear()[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def boundaries(data: bytes) -> list[int]:
    """Where chunks end, in order; the last is the length."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    easy, hard = [], []
    for i in range(0, n, SPAN):
        low = max(0, i - 31)
        h = gear_hashes(raw[low : i + SPAN])[i - low :]
        at = np.flatnonzero(h >> np.uint32(32 - EASY) == 0)
        easy.append(at + i + 1)
        hard.append(h[at] >> np.uint32(32 - HARD) == 0)
    places = np.concatenate(easy).tolist() if easy else []
    firm = np.concatenate(hard).tolist() if hard else []
    ends, start, k = [], 0, 0
    while start < n:
        end = min(n, start + MOST)
        while k < len(places) and places[k] < start + LEAST:
            k += 1
        j = k
        while j < len(places) and places[j] < end:
            if firm[j] or places[j] >= start + USUAL:
                end = places[j]
                break
            j += 1
        ends.append(end)
        start = end
    return ends


def chunk_weights(text: str) -> dict[bytes, int]:
    """Bytes in the chunks of each digest."""
    data, start, out = text.encode(), 0, {}
    for end in boundaries(data):
        digest = xxhash.xxh3_64_digest(data[start:end])
        out[digest] = out.get(digest, 0) + end - start
        start = end
    return out


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """The share of a's bytes in chunks that b has as well; of an empty text, 1 if b is empty too, else 0."""
    if not a:
        return float(not b)
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / sum(a.values())


def as_text(weights: dict[bytes, int]) -> str:
    """Every digest and its bytes, sorted, in base 64."""
    return base64.b64encode(b"".join(d + n.to_bytes(4, "little") for d, n in sorted(weights.items()))).decode()


def from_text(fingerprint: str) -> dict[bytes, int]:
    data = base64.b64decode(fingerprint)
    step = DIGEST_BYTES + 4
    return {data[i : i + DIGEST_BYTES]: int.from_bytes(data[i + DIGEST_BYTES : i + step], "little") for i in range(0, len(data), step)}


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text counts as empty, an empty one has an empty fingerprint."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [as_text(chunk_weights(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(made, "doc_id long, fingerprint string")


# --- every document against its neighbour ---

COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
    " near_next double"
)


def edited(text: str, following: str) -> str:
    """The text with its last third, in code points, replaced by as many from the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in ascending order within it; what follows a document in descending order came before it. A
    range's first row is the one before the range."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.strip().split()[0] for f in COMPARED.split(",")]
    last, before, weights = None, "", {}
    for batch in batches:
        for i in range(0, len(batch), 512):
            rows = []
            part = batch.slice(i, 512)
            for section, guest, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("section", "guest", "doc_id", "text"))):
                own = chunk_weights(text)
                if not guest:
                    if section != last:
                        raise ValueError("a range came without the document before it")
                    changed = edited(text, before)
                    new = chunk_weights(changed)
                    rows.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_text(own), as_text(new), containment(own, new), containment(own, weights)))
                last, before, weights = section, text, own
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def with_sections(docs: DataFrame, cuts: list[float]) -> DataFrame:
    """Rows with the number of the id range they fall in; null ids in the first."""
    section = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    return docs.withColumn("section", F.when(F.col("doc_id").isNull(), 0).otherwise(section))


def compared_with_next(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text (see ``edited``) and the containment of its
    own in the edited text's and in the next document's. The next document is the one before it by (doc_id, text), nulls
    first, and the largest one for the smallest; a lone document follows itself.

    Texts are dealt once to ranges of ids. Each range also gets the document before its first, found from the ids alone; so no
    global order is sorted in one task, and a task holds two texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)))
    rows = with_sections(rows, cuts)
    # the last id of every range that has rows: as many numbers as there are ranges
    ends = rows.groupBy("section").agg(F.max("doc_id").alias("last")).orderBy("section").collect()
    spark = docs.sparkSession
    hosts = [(ends[i - 1].section, ends[i - 1].last, e.section) for i, e in enumerate(ends)]
    goes = spark.createDataFrame(hosts, "s int, last long, host int")
    tails = rows.join(F.broadcast(goes), (F.col("section") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("last")))  # one row a range
    guests = tails.groupBy("host").agg(F.max(F.struct("doc_id", "text")).alias("t")).select("host", "t.*")
    dealt = rows.select("section", F.lit(False).alias("guest"), "doc_id", "text").unionByName(
        guests.select(F.col("host").alias("section"), F.lit(True).alias("guest"), "doc_id", "text")
    )
    order = ["section", F.desc("guest"), "doc_id", "text"]
    return dealt.repartition("section").sortWithinPartitions(*order).mapInArrow(compared_batches, COMPARED)
