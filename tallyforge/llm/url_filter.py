"""URL filtering by rules and listed URLs, through a blocked Bloom filter and an exact join.

An entry is a host and the start of a path; it fits its host and all subdomains. A URL has one canonical key for each of its host's
suffixes and each path length that entries have. The filter passes the keys that may be entries: 256-bit blocks with one
bit in each of eight words, so a probe touches one block. Passing keys meet the entries in an equi-join, which
removes false positives; most URLs never reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ENTRY = 16
#: the filter never grows beyond this; longer lists pass more false positives, which the join removes
MOST_BYTES = 64 << 20
WORDS = 8
# Odd multipliers that choose the bit in each word of a block.
SALTS = np.array(
    [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64
)


def host_of(url: str = "url") -> Column:
    """What stands between the first :// and the next / ? # or the end, A to Z in lower case; empty if there is none."""
    # lower() would also change other letters
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), upper, lower)


def path_of(url: str = "url") -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def after_scheme(url: str) -> Column:
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return F.when(F.instr(text, "://") > 0, F.substring(text, F.instr(text, "://") + 3, F.length(text))).otherwise("")


def entry_table(entries: DataFrame) -> DataFrame:
    """(entry, host, path, verdict, ruled) with host and path split at the entry's first slash."""
    return entries.select(
        "entry", F.substring_index("entry", "/", 1).alias("host"), F.expr("substring(entry, instr(concat(entry, '/'), '/'))").alias("path"), "verdict", "ruled"
    )


# --- the filter ---


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and the eight words of bits that it sets there."""
    block = (hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    mixed = (hashes & np.uint64(0xFFFFFFFF))[:, None] * SALTS & np.uint64(0xFFFFFFFF)
    return block.astype(np.int64), np.uint64(1) << (mixed >> np.uint64(27))


def key_hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k.encode(), 9) for k in keys), np.uint64, len(keys))


def word_batches(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        block, bits = places(key_hashes(batch.column("key").to_pylist()), blocks)
        at = block[:, None] * WORDS + np.arange(WORDS)
        yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(bits.ravel().astype(np.int64))], ["at", "bits"])


def built_filter(entries: DataFrame) -> np.ndarray:
    """The filter's words, at most ``MOST_BYTES`` of them: set in the tasks, combined by a bitwise aggregation."""
    keys = entries.select(F.concat("host", "path").alias("key"))
    blocks = int(max(1, min(keys.count() * BITS_PER_ENTRY // 256 + 1, MOST_BYTES // (4 * WORDS))))
    words = np.zeros(blocks * WORDS, np.uint32)
    made = keys.mapInArrow(lambda it: word_batches(it, blocks), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[made.column("at").to_numpy()] = made.column("bits").to_numpy().astype(np.uint32)
    return words


def passes(words: np.ndarray, keys: list[str]) -> np.ndarray:
    block, bits = places(key_hashes(keys), len(words) // WORDS)
    return ((words.reshape(-1, WORDS)[block] & bits.astype(np.uint32)) != 0).all(axis=1)


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """A key for each suffix of the host's labels and each entry path length that the path reaches."""
    labels = host.split(".")
    starts = [path[:n] for n in lengths if n <= len(path)]
    return [".".join(labels[i:]) + s for i in range(len(labels)) for s in starts]


def possible_batches(batches: Iterator[pa.RecordBatch], words, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 4096):
            part = batch.slice(i, 4096)
            made = [keys_of(h, p, lengths) for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist())]
            owner = np.repeat(np.arange(len(made)), [len(m) for m in made])
            flat = [k for m in made for k in m]
            hit = np.flatnonzero(passes(words.value, flat)) if flat else np.zeros(0, np.int64)
            at = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays(
                [part.column("host").take(at), part.column("path").take(at), pa.array([flat[k] for k in hit.tolist()], pa.string())], ["host", "path", "key"]
            )


# --- verdicts ---


def judged(pages: DataFrame, entries: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page row.

    ``entries`` has (entry, verdict, ruled): an entry is a host and the start of a path, as ``example.org/es/``. The longest fitting
    entry decides, rules before listed URLs; ``rule`` names it if it is a rule. Entries of one length fall back on their order as
    text. A URL that nothing fits gets ``default``. Null URLs and URLs without :// have an empty host and path and fit nothing. Repeated
    pages and entries do no harm.

    Each distinct (host, path) is judged once, so a host that holds a third of all pages is not joined row by row.
    """
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of().alias("host"), path_of().alias("path"))
    listed = entry_table(entries).groupBy(F.concat("host", "path").alias("key")).agg(
        F.max(F.struct(F.col("ruled"), F.length("entry").alias("n"), "entry", "verdict")).alias("e")
    )
    keyed = entry_table(entries)
    lengths = sorted(r.n for r in keyed.select(F.length("path").alias("n")).distinct().collect())  # no more than a URL is long
    words = pages.sparkSession.sparkContext.broadcast(built_filter(keyed))
    distinct = urls.select("host", "path").distinct()
    possible = distinct.mapInArrow(lambda it: possible_batches(it, words, lengths), "host string, path string, key string")
    best = possible.join(listed, "key").groupBy("host", "path").agg(F.max("e").alias("e"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), "e")
    out = urls.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select(
        "page_id", "host", "path", F.when(F.col("e.ruled"), F.col("e.entry")).alias("rule"), F.coalesce("e.verdict", F.lit(default)).alias("verdict")
    )
