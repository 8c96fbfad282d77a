"""How filters act on each other: what each removes in every order in which they can be applied.

A byte transducer with two states, inside and outside a word, passes over the UTF-8 bytes of a batch of texts once. Its table gives for each
byte whether it belongs to a word, starts a code point, is a capital or a symbol; entering and leaving the state "inside"
delimits word spans. Spans are inserted into an open-addressing hash table of (text, word) whose every hit is verified byte by
byte, so counts of distinct words are exact.

Of each text only its failures and a digest leave the task. Equal texts meet as one row for each digest, part and label, and all orders
are worked out from the number of documents for each part and set of failed filters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import whole_text

FILTERS = "ABCDE"
#: bytes of text that pass through the transducer together
BATCH_BYTES = 8_000_000
MEASURES = ("words", "distinct_words", "code_points", "capitals", "symbols")

# The bytes that separate words, and the symbols that filter D looks for.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#$%&*|"

#: the transducer's table: what each byte puts out
IN_WORD, STARTS, CAPITAL, SYMBOL = 1, 2, 4, 8
OUTPUT = np.array(
    [
        (IN_WORD if b not in BLANKS else 0)
        | (STARTS if b & 0xC0 != 0x80 else 0)
        | (CAPITAL if 0x41 <= b <= 0x5A else 0)
        | (SYMBOL if b in SYMBOLS else 0)
        for b in range(256)
    ],
    np.uint8,
)
#: keeps the first 0 to 8 bytes of a little-endian chunk
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Starts, lengths and texts of all words, and the counts of each text; ``offsets`` delimit the texts in ``data``."""
    out = OUTPUT[data]
    inside = (out & IN_WORD).astype(bool)
    first = np.zeros(data.size + 1, bool)
    first[offsets] = True
    # every text begins in the state "outside"
    enters = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    leaves = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    owners = np.searchsorted(offsets, enters, "right") - 1

    def per_text(bit: int) -> np.ndarray:
        places = np.flatnonzero(out & bit)
        return np.diff(np.searchsorted(places, offsets))

    counts = {
        "words": np.bincount(owners, minlength=offsets.size - 1),
        "code_points": per_text(STARTS),
        "capitals": per_text(CAPITAL),
        "symbols": per_text(SYMBOL),
    }
    return enters, leaves - enters, owners, counts


def chunk(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each span, zero beyond its end."""
    return words[starts + 8 * k] & KEEP[np.clip(lengths - 8 * k, 0, 8)]


def span_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> np.ndarray:
    hashes = (owners.astype(np.uint64) << np.uint64(24)) + lengths.astype(np.uint64)
    left, k = np.arange(starts.size), 0
    while left.size:
        h = (hashes[left] ^ chunk(words, starts[left], lengths[left], k)) * SPREAD
        hashes[left] = h ^ (h >> np.uint64(29))
        k += 1
        left = left[lengths[left] > 8 * k]
    return hashes * SPREAD


def same_spans(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether spans a and b, of equal lengths, hold the same bytes."""
    same = np.ones(a.size, bool)
    left, k = np.arange(a.size), 0
    while left.size:
        x, y = a[left], b[left]
        same[left] = equal = chunk(words, starts[x], lengths[x], k) == chunk(words, starts[y], lengths[y], k)
        k += 1
        left = left[equal & (lengths[x] > 8 * k)]
    return same


def distinct_per_text(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray, n_texts: int) -> np.ndarray:
    """Number of different words of each text, by inserting all spans into one hash table.

    All spans still on their way look at one slot each: an empty slot takes one of them; a span whose slot holds the same word of its
    text is a repeat, verified by its bytes; any other moves on to the next slot.
    """
    bits = max(4, int(2 * starts.size).bit_length())
    slots = np.full(1 << bits, -1, np.int64)
    where = (span_hashes(words, starts, lengths, owners) >> np.uint64(64 - bits)).astype(np.int64)
    left = np.arange(starts.size)
    while left.size:
        at = where[left]
        free = slots[at] < 0
        slots[at[free]] = left[free]
        holder = slots[at]
        alike = (owners[holder] == owners[left]) & (lengths[holder] == lengths[left])
        near = np.flatnonzero(alike)
        alike[near] = same_spans(words, starts, lengths, holder[near], left[near])
        left = left[~alike]
        where[left] = (where[left] + 1) & (slots.size - 1)
    return np.bincount(owners[slots[slots >= 0]], minlength=n_texts)


def measured(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    # eight more bytes, so that a chunk can be read at every place
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    words = np.ndarray((data.size - 7,), np.dtype("<u8"), data, 0, (1,))
    starts, lengths, owners, counts = spans(data[:-8], offsets)
    return counts | {"distinct_words": distinct_per_text(words, starts, lengths, owners, len(texts))}


def measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [str(t).encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        a = 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            while b < len(texts) and size + len(texts[b]) <= BATCH_BYTES:
                size += len(texts[b])
                b += 1
            found = measured(texts[a:b])
            digests = pa.array([hashlib.sha256(t).digest() for t in texts[a:b]], pa.binary())
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), digests, *[pa.array(found[m], pa.int64()) for m in MEASURES]],
                ["doc_id", "part", "digest", *MEASURES],
            )
            a = b


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, words, distinct_words, code_points, capitals, symbols) of each document. ``part`` is its lang, an empty
    string where that is null."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), whole_text().alias("text")
    )
    kinds = "doc_id long, part string, digest binary, " + ", ".join(f"{m} long" for m in MEASURES)
    return rows.mapInArrow(measure_batches, kinds)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents of each part that fail exactly the filters whose bits are set in ``failed``, and
    how many of them are labelled good and toxic."""
    own = {
        "A": F.col("words") < 200,
        "B": 100 * F.col("distinct_words") < 50 * F.col("words"),
        "C": 100 * F.col("capitals") > 3 * F.col("code_points"),
        "D": F.col("symbols") > 0,
    }
    bits = sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in own.items()), F.lit(0))
    rows = measures(docs).select("doc_id", "part", "digest", bits.alias("failed"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = rows.join(known, "doc_id", "left").fillna(False, ["good", "toxic"])
    keys = ["digest", "part", "failed", "good", "toxic"]
    # copies are counted before they travel: a row for each text, part and label, with the smallest id and the number of rows that have it
    rows = rows.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    place = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias("place")  # a null id is above all others
    rows = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.struct(place, "n")).alias("least"))
    rows = rows.withColumn("first", F.min("least.place").over(Window.partitionBy("digest")))
    fresh = F.when(F.col("least.place") == F.col("first"), F.col("least.n")).otherwise(0).cast("long")
    copies = F.lit(1 << FILTERS.index("E"))
    either = F.array(F.struct(F.col("failed").alias("set"), fresh.alias("m")), F.struct((F.col("failed") + copies).alias("set"), (F.col("n") - fresh).alias("m")))
    return rows.select("part", "good", "toxic", F.inline(either)).where("m > 0").groupBy("part", F.col("set").alias("failed")).agg(
        F.sum("m").alias("n"), F.sum(F.when(F.col("good"), F.col("m")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("m")).otherwise(0)).alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter does at every step of every order, for each part (a lang; null is the empty string).

    A fails texts of under 200 words; B those of which less than half of the words are different; C those of more than 3 % capitals A-Z;
    D those with any of ``#$%&*|``; E those equal to the text of any smaller doc_id in the whole table. Columns: part, filter_order,
    step (1 to 5), then numbers of documents: kept after the step, removed by it, redundant (failing its filter, but removed
    earlier), unique_fails (failing no other filter), good_lost and toxic_lost (removed and labelled so), shapley (removed by its filter over
    all 120 orders).

    Null texts are empty: they fail A, and E where another empty text has a smaller id. Texts are read whole; the longest one bounds a task's memory. Rows of
    equal doc_id and text are no copies of each other, but count each; a null doc_id is above all others and equal to other nulls. Of several labels of a
    document, any that says good or toxic holds; null labels say nothing. Other columns are not read. An empty table has no parts and gives no rows.
    """
    def bit(letter):
        return F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))

    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    # at most 32 rows a part, so 19,200 after this
    rows = failures(docs, labels).withColumn("filter_order", F.explode(orders))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("before", "letter")).withColumn("bit", bit(F.col("letter")))
    earlier = F.slice(F.split("filter_order", ""), 1, F.col("before"))
    rows = rows.withColumn("earlier", F.aggregate(earlier, F.lit(0), lambda bits, x: bits.bitwiseOR(bit(x)))).withColumn("step", F.col("before") + 1)
    fails = F.col("failed").bitwiseAND(F.col("bit")) > 0
    gone = F.col("failed").bitwiseAND(F.col("earlier")) > 0

    def total(condition, value="n"):
        return F.sum(F.when(condition, F.col(value)).otherwise(0))

    counted = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
