"""SimHash near-duplicates found by the generalised pigeonhole principle.

Fingerprints of 64 bits are compared within a small radius. Correlated bits are grouped into parts; every part gets its
own threshold, the thresholds summing to ``radius - parts + 1``, so two fingerprints within the radius agree on at least one
part up to its threshold. A dynamic programme chooses the thresholds (and the number of parts) that keep the
estimated number of candidates lowest.
Parts are probed and pairs verified by their Hamming distance. Parts' values shared by more than ``BUCKET`` fingerprints
are not paired: their members meet on the values halfway between two fingerprints, at most 65 to each,
which finds the same links from a number of rows proportional to the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import components, discard, stored, whole_text

BITS = 64
BUCKET = 64
#: what one probe costs, measured in verified pairs
PROBE_COST = 4.0
#: 64-bit words of the code that estimates similarity in ``near_duplicates``
CODE_WORDS = 16
#: pairs whose estimate falls short of the similarity by this much, three times its error, are still counted exactly
SLACK = 0.06
FEW_ROWS = 255
#: shingles that ``COMMON`` of every ``SAMPLED``th document have go last in the order of shingles, ``MOST_COMMON`` of them; any
#: order finds the same pairs, this one with fewer candidates
SAMPLED, COMMON, MOST_COMMON = 16, 4, 200_000
#: a bucket of so many sets is compared pair by pair; larger ones are joined in slices of about ``SLICE`` sets
FEW, SLICE = 8, 256
#: words whose hashes a task remembers
REMEMBERED = 200_000


# --- fingerprints ---


@cache
def spread() -> np.ndarray:
    """For each byte a word whose eight lanes hold the byte's bits."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of hashes: the bits set in over half of them; 0 for an empty run.

    Bits are counted in byte lanes of 64-bit words, over at most 255 hashes at once so that no lane overflows.
    """
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    sizes = lengths[full]
    pieces = -(-sizes // FEW_ROWS)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * FEW_ROWS
    ends = np.append(starts[1:], len(hashes))
    parts = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    counts = np.zeros((len(full), BITS), np.int64)
    for i in range(0, len(starts), 256):
        j = min(i + 256, len(starts))
        lanes = spread()[parts[starts[i] : ends[j - 1]]]
        sums = np.add.reduceat(lanes, starts[i:j] - starts[i], axis=0)
        own, first = np.unique(owner[i:j], return_index=True)
        counts[own] += np.add.reduceat(np.ascontiguousarray(sums).view(np.uint8).astype(np.int64), first, axis=0)
    bits = (counts * 2 > sizes[:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], size: int, seed: int) -> list[int]:
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)))), repeat(seed)))


def fingerprint_batches(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, made, pending, lengths = batch.column("text"), [], [], []
        for i in range(len(texts)):
            h = shingle_hashes(words_of(texts[i].as_py()), size, seed)
            pending.append(np.array(h, np.uint64))
            lengths.append(len(h))
            if sum_over(lengths, 200_000) or i + 1 == len(texts):
                made.append(majority(np.concatenate(pending), np.array(lengths)))
                pending, lengths = [], []
        values = np.concatenate(made) if made else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def sum_over(lengths: list[int], most: int) -> bool:
    return lengths[-1] > most or len(lengths) % 64 == 0 and sum(lengths) > most


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): SimHash over the ``size``-word shingles of each whole text, repeats included. A null or blank text
    has fingerprint 0. Other columns are ignored; every row gives a row."""
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(
        lambda it: fingerprint_batches(it, size, seed), "doc_id long, fp long"
    )


# --- parts and thresholds ---


def bit_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        bits = np.unpackbits(batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        x = bits.astype(np.float32)
        total, n = total + x.T @ x, n + len(x)
    if n:
        at = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total.ravel(), n))], ["at", "n"])


def grouped_bits(moments: np.ndarray, n: float, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size, each grown around its most correlated bits."""
    mean = np.diag(moments) / n
    cov = moments / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        wanted = len(left) // (parts - k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < wanted:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def match_chance(agree: np.ndarray, most: int) -> list[float]:
    """Chance that two random fingerprints differ in at most 0, 1, ... ``most`` of the bits, from each bit's chance
    to agree."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in agree:
        dist = dist * q + np.append(0, dist[:-1]) * (1 - q)
    return list(np.cumsum(dist))


def allot(moments: np.ndarray, n: float, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, for the lowest estimated cost over up to radius + 2 parts.

    Thresholds may be -1 (part not probed); they sum to ``radius - parts + 1``.
    """
    mean = np.diag(moments) / n
    agree = mean**2 + (1 - mean) ** 2
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for parts in range(1, radius + 3):
        groups = grouped_bits(moments, n, parts)
        state = {0: (0.0, [])}
        for bits in groups:
            chance = match_chance(agree[bits], radius)
            cost = {-1: 0.0}
            for t in range(radius + 1):
                cost[t] = PROBE_COST * n * sum(comb(len(bits), j) for j in range(t + 1)) + n * n / 2 * chance[t]
            after: dict[int, tuple[float, list]] = {}
            for used, (paid, chosen) in state.items():
                for t, c in cost.items():
                    option = (paid + c, [*chosen, (bits, t)])
                    if used + t not in after or option[0] < after[used + t][0]:
                        after[used + t] = option
            state = after
        paid, chosen = state.get(radius - parts + 1, (np.inf, []))
        if paid < best[0]:
            best = paid, [x for x in chosen if x[1] >= 0]
    return best[1]


# --- links ---


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(bits: list[int], most: int) -> list[int]:
    """The words with up to ``most`` of the bits set, zero first."""
    return [signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(grp, a, b): fingerprints of one group within ``radius`` bits, from distinct rows (grp, fp).

    Every such pair is linked, through a shared neighbour at least; pairs in buckets up to ``BUCKET`` directly. No
    pair farther apart appears.
    """
    rows = fps.select("fp").mapInArrow(bit_moments, "at long, n double").groupBy("at").agg(F.sum("n").alias("n"))
    sums = np.zeros(BITS * BITS + 1)
    for at, n in rows.collect():  # 4097 sums, whatever the number of fingerprints
        sums[at] = n
    if not sums[-1]:
        return fps.select("grp", F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    parts = allot(sums[:-1].reshape(BITS, BITS), sums[-1], radius)
    probes = [
        F.struct(F.lit(p).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(d)).alias("value"), F.lit(not d).alias("own"))
        for p, (bits, t) in enumerate(parts)
        for mask in [signed(sum(1 << b for b in bits))]
        for d in flips(bits, t)
    ]
    probed = fps.select("grp", "fp", F.inline(F.array(*probes)))
    key = ["grp", "part", "value"]
    sizes = probed.groupBy(*key).agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("n > 1 AND owned")
    met = stored(probed.join(sizes.drop("owned"), key), "simhash-probes")
    near = f"bit_count(x.fp ^ y.fp) <= {radius}"
    pairs = (
        met.where(f"n <= {BUCKET}")
        .groupBy(*key)
        .agg(F.collect_list(F.struct("fp", "own")).alias("l"))
        .select(
            "grp",
            F.expr(
                "inline(flatten(transform(l, x -> transform(filter(l, y -> y.fp > x.fp AND (x.own OR y.own) AND "
                f"{near}), y -> struct(x.fp AS a, y.fp AS b)))))"
            ),
        )
    )
    ball = flips(list(range(BITS)), (radius + 1) // 2)
    mids = F.explode(F.transform(F.array(*map(F.lit, ball)), lambda d: F.col("fp").bitwiseXOR(d))).alias("mid")
    halfway = (
        met.where(f"n > {BUCKET}")
        .select("grp", "fp")
        .distinct()
        .select("grp", "fp", mids)
        .groupBy("grp", "mid")
        .agg(F.collect_list(F.struct("fp")).alias("l"))
        .where("size(l) > 1")
    )
    if radius % 2 == 0:  # any two of a value's members are within the radius: point all to the smallest
        halfway = halfway.select("grp", F.array_min("l")["fp"].alias("a"), F.explode("l.fp").alias("b")).where("a <> b")
    else:
        halfway = halfway.select(
            "grp",
            F.expr(f"inline(flatten(transform(l, x -> transform(filter(l, y -> y.fp > x.fp AND {near}), y -> struct(x.fp AS a, y.fp AS b)))))"),
        )
    return pairs.unionByName(halfway).distinct()


def fingerprint_components(docs: DataFrame, size: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents linked when their fingerprints differ in at most ``radius`` bits; the
    component id is the smallest doc_id reachable.

    Documents with one fingerprint are one node from the start, so groups of copies never meet as pairs. Rows with a
    null doc_id take part; a component of nothing else has a null id. Repeated rows give repeated results; an
    empty table gives none.
    """
    made = stored(fingerprints(docs, size, seed), "simhash-fingerprints")
    nodes = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(nodes.select(F.lit(0).alias("grp"), "fp"), radius)
    roots = components(edges, "simhash-components")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        nodes.fp, "least", F.coalesce("root", nodes.fp).alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.join(smallest, "root").select(F.col("fp").alias("of"), "component_id")
    return made.join(label, made.fp == F.col("of")).select("doc_id", "fp", "component_id")


# --- near-duplicates at a similarity ---


def mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Another independent hash of each hash."""
    z = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(30))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each text its words in one string, and the distinct hashes of its shingles."""
    known: dict[bytes, int] = {}
    for text in texts:
        words = words_of(text.as_py())
        joined = b" ".join(words)
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        if len(words) > size:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            s = np.zeros(len(h) - size + 1, np.uint64)
            for j in range(size):
                s = mixed(s + h[j : len(h) - size + 1 + j], j)
        else:
            s = np.array([xxhash.xxh64_intdigest(joined)] if words else [], np.uint64)
        yield joined, np.unique(s)


def shingle_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, s in shingle_sets(batch.column("text"), size):
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])


def common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles, sorted, and in how many sampled documents they are."""
    part = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").distinct()
    counts = part.mapInArrow(lambda it: shingle_batches(it, size), "h long").groupBy("h").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    hashes, n = np.array([r.h for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefix(s: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first elements of a set in an order that all sets share, so many that sets at least ``similarity`` alike have one of these
    in common."""
    if not len(s):
        return s
    hashes, counts = common
    rank = np.zeros(len(s), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
        rank = np.where(hashes[at] == s, counts[at], 0)
    return s[np.lexsort((s, rank))[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]]


def code_batches(batches: Iterator[pa.RecordBatch], size: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        keys, sizes, prefixes, codes, pending, held = [], [], [], [], [], 0
        for i, (joined, s) in enumerate(shingle_sets(texts, size)):
            keys.append(xxhash.xxh3_128_hexdigest(joined))
            sizes.append(len(s))
            prefixes.append(prefix(s, similarity, common).view(np.int64))
            pending.append(s)
            held += len(s)
            if held > 200_000 or i + 1 == len(texts):
                flat, lengths = np.concatenate(pending), np.array([len(p) for p in pending])
                codes.extend(np.stack([majority(mixed(flat, 100 + j), lengths) for j in range(CODE_WORDS)], axis=1).view(np.int64).tolist())
                pending, held = [], 0
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(prefixes, kind), pa.array(codes, kind)],
            ["doc_id", "digest", "k", "size", "prefix", "code"],
        )


def set_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts, at, pending, held = batch.column("k"), batch.column("text"), 0, [], 0
        for i, (_, s) in enumerate(shingle_sets(texts, size)):
            pending.append(s.view(np.int64))
            held += len(s)
            if held > 200_000 or i + 1 == len(texts):
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(pending)), pa.array(pending, pa.list_(pa.int64()))], ["k", "s"])
                at, pending, held = i + 1, [], 0


def counted_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b): the pairs whose shingle sets are at least so alike, counted exactly. Sets are made anew, of the texts in these pairs only, and not
    kept for all nodes: they take about as much room as the texts."""
    pairs = stored(pairs.select("a", "b").distinct(), "simhash-estimated")
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    wanted = stored(ends.join(nodes.select("k", F.col("least.digest").alias("digest")), "k"), "simhash-wanted")
    one_each = texts.select("digest", "text").join(wanted, "digest").groupBy("k").agg(F.first("text").alias("text"))
    sets = stored(one_each.mapInArrow(lambda it: set_batches(it, size), "k string, s array<long>"), "simhash-sets")
    # the side that may name one node very often is joined first, when rows are narrow
    met = pairs.join(sets.select(F.col("k").alias("b"), F.col("s").alias("t")), "b").join(sets.withColumnRenamed("k", "a"), "a")
    both = F.size(F.array_intersect("s", "t"))
    alike = stored(met.where(both >= similarity * (F.size("s") + F.size("t") - both) - 1e-9).select("a", "b"), "simhash-alike")
    discard(pairs, wanted, sets)
    return alike


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(h, k, size, pos, n, rank): the nodes that share a prefix shingle with others, the shingle's place in the node's order, the number of
    nodes that share it, and what part of its prefix a node shares with any."""
    spread = nodes.select("k", "size", F.size("prefix").alias("p"), F.posexplode("prefix").alias("pos", "h"))
    shared = spread.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(spread.join(shared, "h"), "simhash-shared")
    degree = met.groupBy("k").agg((F.count("*") / F.first("p")).alias("rank"))
    rows = stored(met.drop("p").join(degree, "k"), "simhash-buckets")
    discard(met)
    return rows


def most_apart(similarity: float) -> int:
    """Bits by which the codes of two sets may differ that are worth counting."""
    least = similarity - SLACK
    return int(CODE_WORDS * BITS * np.arccos(2 * least / (1 + least)) / np.pi)


def apart(a: str, b: str) -> Column:
    """Number of bits in which two codes differ."""
    return reduce(Column.__add__, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(CODE_WORDS)])


def may_be_alike(similarity: float) -> Column:
    """Whether two sets, (size, pos) and (hs, hp), can be alike if the shingle at these places is the first they share: all they share then
    lies from there on. Alike sets pass at their first common shingle, so none is lost."""
    rest = F.least(F.col("size") - F.col("pos"), F.col("hs") - F.col("hp"))
    return rest * (1 + similarity) >= (F.col("size") + F.col("hs")) * similarity - 1e-6


def few_pairs(rows: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs, alike by estimate, of buckets with few members, all of which are compared: at most ``FEW`` pairs for each row."""
    other = rows.select("h", F.col("k").alias("hk"), F.col("size").alias("hs"), F.col("pos").alias("hp"))
    pairs = rows.join(other, "h").where((F.col("k") < F.col("hk")) & may_be_alike(similarity)).select("k", "hk").distinct()
    codes = nodes.select("k", "code")
    return (
        pairs.join(codes, "k")
        .join(codes.select(F.col("k").alias("hk"), F.col("code").alias("hc")), "hk")
        .where(apart("code", "hc") <= most_apart(similarity))
        .select(F.col("k").alias("a"), F.col("hk").alias("b"))
    )


def fingerprint_pairs(nodes: DataFrame, similarity: float, radius: int = 2) -> DataFrame:
    """(a, b): pairs, alike by estimate, found through their fingerprints, the first words of their codes: nodes of one fingerprint with the smallest of these, and
    the smallest of fingerprints that ``links`` finds within ``radius`` bits. Codes are compared; a row per node and link."""
    prints = nodes.select(F.col("code")[0].alias("fp"), "k", "code")
    least = stored(prints.groupBy("fp").agg(F.min(F.struct("k", "code")).alias("m")).select("fp", F.col("m.k").alias("hk"), F.col("m.code").alias("hc")), "simhash-least")
    near = links(least.select(F.lit(0).alias("grp"), "fp"), radius).select("a", "b")
    met = near.join(least.select(F.col("fp").alias("b"), "hk", "hc"), "b")
    met = met.join(least.select(F.col("fp").alias("a"), F.col("hk").alias("k"), F.col("hc").alias("code")), "a")
    same = prints.join(least, "fp").where("k <> hk")
    both = same.select("k", "code", "hk", "hc").unionByName(met.select("k", "code", "hk", "hc"))
    return both.where(apart("code", "hc") <= most_apart(similarity)).select(F.col("k").alias("a"), F.col("hk").alias("b"))


def head_pairs(rows: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs, alike by estimate, of a head and another member of its bucket with another root. Codes are compared within the join, which lets
    only these out; a bucket is joined in slices of about ``SLICE`` members, each with a copy of the heads."""
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("k"), slices).cast("int"))
    heads = heads.select(
        "h", F.col("k").alias("hk"), F.col("size").alias("hs"), F.col("pos").alias("hp"), F.col("root").alias("hr"),
        F.col("code").alias("hc"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"),
    )
    far = apart("code", "hc") <= most_apart(similarity)
    met = rows.join(heads, ["h", "slice"]).where((F.col("root") != F.col("hr")) & may_be_alike(similarity) & far)
    return met.select(F.col("k").alias("a"), F.col("hk").alias("b")).distinct()


def similar_roots(nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(node, root): components of nodes that are alike.

    Pairs within two bits of a fingerprint come first, by the pigeonhole principle; the prefix filter finds all others. Its
    buckets of few members are compared pair by pair. In larger ones, each round some members, sixteen times as many as before, are the
    heads and meet all others. Members known to be of one component are not compared; a bucket is done when all members that
    have not been heads are of one component. What a round wrote is deleted after the next. All pairs found are counted in their sets before
    they link anything.
    """
    buckets, heads_each = bucket_rows(nodes), 1
    few = few_pairs(buckets.where(F.col("n") <= FEW), nodes, similarity)
    found = counted_pairs(fingerprint_pairs(nodes, similarity).unionByName(few), nodes, texts, size, similarity)
    roots = components(found, "simhash-near", tidy=True)
    rows = stored(buckets.where(F.col("n") > FEW).join(nodes.select("k", "code"), "k"), "simhash-large")
    discard(buckets, found)
    spent = [rows]
    while True:
        labelled = rows.join(roots, rows.k == roots.node, "left").select(*rows.columns, F.coalesce("root", "k").alias("root"))
        mixed_buckets = labelled.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        live = stored(labelled.join(mixed_buckets.select("h"), "h", "left_semi"), "simhash-live")
        discard(*spent)
        if live.isEmpty():
            return roots
        order = Window.partitionBy("h").orderBy(F.desc("rank"), "k")
        heads = stored(live.withColumn("nth", F.row_number().over(order)).where(f"nth <= {heads_each}").drop("nth"), "simhash-heads")
        found = counted_pairs(head_pairs(live, heads, similarity), nodes, texts, size, similarity)
        if not found.isEmpty():
            known, before = roots.select(F.col("node").alias("a"), F.col("root").alias("b")), roots
            roots = components(found.unionByName(known), "simhash-near", tidy=True)
            discard(before)
        rows = live.drop("root").join(heads.select("h", "k"), ["h", "k"], "left_anti")
        spent, heads_each = [live, heads, found], heads_each * 16


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, digest, component, kept): groups of texts whose ``size``-word shingle sets are at least
    ``similarity`` alike (Jaccard), and one kept row of each.

    Candidates come from fingerprints of 64 bits within a radius of 2, found as in ``links``, and, for pairs whose fingerprints are farther
    apart, from a prefix filter, which misses no pair: shingles have one order, rare ones first, and two sets that are alike share
    one of the first fifth of their shingles, the first common one early enough to leave room for all that they must share. The members of a
    shingle's bucket are compared in rounds until all pairs have been, or are known to be in one group.
    The similarity of each candidate is estimated by 1024 SimHash bits over the shingles, whose distance gives the angle between the sets, to
    about 0.02; where the estimate allows it, the sets themselves are counted, so the order of shingles does not show in the
    result. Texts with equal words are one node. ``digest`` is the text's MD5.

    Blank and null texts form one group. The row with the smallest (doc_id, digest) is kept, nulls first; repeated rows all carry its mark.
    """
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("digest", F.md5("text"))
    common = common_shingles(rows, size)
    made = stored(
        rows.mapInArrow(
            lambda it: code_batches(it, size, similarity, common),
            "doc_id long, digest string, k string, size long, prefix array<long>, code array<long>",
        ),
        "simhash-codes",
    )
    nodes = stored(
        made.groupBy("k").agg(F.min(F.struct("doc_id", "digest")).alias("least"), *(F.min(c).alias(c) for c in ("size", "prefix", "code"))),
        "simhash-nodes",
    )
    roots = similar_roots(nodes, rows, size, similarity)
    rooted = nodes.join(roots, nodes.k == roots.node, "left").select("k", "least", F.coalesce("root", "k").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    label = rooted.join(best, "root").select("k", F.col("root").alias("component"), "best")
    return made.join(label, "k").select(
        "doc_id", "digest", "component", F.struct("doc_id", "digest").eqNullSafe(F.col("best")).alias("kept")
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents with one row of every near-duplicate group left, columns as they came."""
    kept = near_duplicates(docs, **how).where("kept").select(F.col("doc_id").alias("i"), F.col("digest").alias("d")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select(
        "row", F.col("row.doc_id").cast("long").alias("i"), F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("d")
    )
    on = rows.i.eqNullSafe(kept.i) & (rows.d == kept.d)
    met = rows.join(kept, on, "left_semi")
    return met.groupBy("d", "i").agg(F.first("row").alias("row")).select("row.*")
