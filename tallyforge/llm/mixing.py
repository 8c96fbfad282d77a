"""Mixing sources to target weights by entropy balancing.

Every document gets the rate closest to 1, in relative entropy, among all rates up to ``MOST`` under which each source's
words meet its target. The dual of that problem is convex; its solution tilts rates exponentially, a document of s words in
source k having rate min(MOST, exp(lambda_k * s / mean size of the source)). Newton steps find all lambdas at once; each is one
aggregation over (source, size, documents) counts. Rates are then rounded into whole copies: in order of size,
a group's extra copies are the whole steps that the running sum of fractions makes, so a source misses its target by about one document's size at most.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import WORD, stored, whole_text

#: weights by a source's rank, repeating
WEIGHTS = (5.0, 2.0, 1.0)
#: no source and no document is taken more often
MOST = 3.0
STEPS = 60
#: relative distance from the target at which Newton's steps end
CLOSE = 1e-9
#: documents of one source and size that are ranked together, on average
CELL = 500


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size).

    Sources are ranked by code point, null last; their weights share all words. A target stops at ``most`` times its
    source's size and what it leaves is shared again by weight. The level that ends this is found directly: with sources in
    order of size for weight, those up to some place stop, and the rest take the remainder by weight.
    """
    ranked = sources.withColumn("place", F.expr("row_number() OVER (ORDER BY source IS NULL, source) - 1"))
    shares = F.array(*map(F.lit, weights))
    ranked = ranked.withColumn("w", F.element_at(shares, (F.col("place") % len(weights)).cast("int") + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("ratio", F.expr("limit / w"))
    run = "OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ranked = ranked.selectExpr(
        "*", f"coalesce(sum(limit) {run}, 0D) AS stopped", f"coalesce(sum(w) {run}, 0D) AS stopped_w", "sum(source_size) OVER () AS words", "sum(w) OVER () AS all_w"
    )
    # the level that holds if all sources before this one stop and this one does not
    ranked = ranked.withColumn("level", F.expr("(words - stopped) / (all_w - stopped_w)"))
    level = F.expr("min(CASE WHEN level <= ratio THEN struct(ratio, place, level) END) OVER ()")["level"]
    return ranked.select("source", "source_size", F.least(F.col("limit"), F.col("w") * level).alias("target"))


def solved_rates(cells: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """(source, tilt): lambda over the mean size of each source, from cells (source, size, n)."""
    wide = cells.where("size > 0").select(F.col("source").alias("s"), F.col("size").cast("double").alias("z"), F.col("n").cast("double").alias("n"))
    wide = stored(wide, "mixing-sizes")
    state = goals.where(f"source_size > 0 AND target < {most}D * source_size").select(
        "source",
        F.col("target").alias("goal"),
        (F.col("source_size") / F.col("docs")).alias("mean"),
        F.lit(0.0).alias("x"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
        F.lit(False).alias("done"),
    )
    state = stored(state, "mixing-state")
    for _ in range(STEPS):
        tilted = wide.join(state.where("not done"), wide.s.eqNullSafe(state.source))
        rate = F.expr(f"least({most}D, exp(least(700D, x * z / mean)))")
        slope = F.expr(f"CASE WHEN exp(least(700D, x * z / mean)) < {most}D THEN n * z * z / mean * exp(x * z / mean) ELSE 0D END")
        sums = tilted.groupBy("s").agg(F.sum(F.col("n") * F.col("z") * rate).alias("got"), F.sum(slope).alias("slope"), F.max("z").alias("widest"))
        state = state.join(sums, state.source.eqNullSafe(sums.s), "left").drop("s")
        state = state.selectExpr(
            "source", "goal", "mean", "x",
            "CASE WHEN got < goal THEN x ELSE low END AS low",
            "CASE WHEN got > goal THEN x ELSE high END AS high",
            f"done OR abs(got - goal) <= {CLOSE}D * goal AS done",
            "x + (goal - got) / nullif(slope, 0D) AS newton",
        )
        # a step that leaves the bracket, or has no slope, halves it; an open side is doubled
        inside = "newton > coalesce(low, x - 4D) AND newton < coalesce(high, x + 4D)"
        halved = "CASE WHEN low IS NULL THEN x - 4D WHEN high IS NULL THEN 2D * abs(x) + 1D ELSE (low + high) / 2 END"
        state = state.withColumn("x", F.expr(f"CASE WHEN done THEN x WHEN {inside} THEN newton ELSE {halved} END"))
        state = stored(state.drop("newton"), "mixing-state")
        if state.where("not done AND (high IS NULL OR low IS NULL OR high - low > 1e-12 * (1 + abs(x)))").isEmpty():
            break
    return state.select("source", (F.col("x") / F.col("mean")).alias("tilt"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the hash that orders documents of one source and size."""
    source = F.col("source").cast("string").alias("source")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source, word_count().alias("size"), F.xxhash64(F.lit(10), F.col("doc_id").cast("long")).alias("h")
    )


def copies(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, size, sub, source_size, target, base, below): what decides each document's copies.

    ``rows`` has (source, size, h). A document whose (source, size) and ``sub`` = h modulo ``subs`` fall in a row is taken
    ``base`` times, once more if h <= ``below``. Cells of one source and size are split by hash into parts of about ``CELL``
    documents, so one size that holds a third of all documents is ranked in many tasks.
    """
    cells = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mixing-cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"))
    goals = stored(sizes.join(targets(sizes.select(F.col("source").alias("k"), "source_size").withColumnRenamed("k", "source"), weights, most).select(F.col("source").alias("k"), "target"), F.col("source").eqNullSafe(F.col("k"))).drop("k"), "mixing-targets")
    tilts = solved_rates(cells, goals, most).withColumnRenamed("source", "k")
    cells = cells.withColumn("subs", F.ceil(F.col("n") / CELL).cast("long"))
    rated = cells.join(goals.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    rated = rated.join(tilts, F.col("source").eqNullSafe(F.col("k")), "left").drop("k")
    # empty documents count for nothing and are taken once; a source without words keeps its documents
    rated = rated.withColumn("rate", F.expr(f"CASE WHEN size = 0 THEN 1D WHEN target >= {most}D * source_size THEN {most}D WHEN tilt IS NULL THEN 1D ELSE least({most}D, exp(least(700D, tilt * size))) END"))
    rated = rated.withColumn("base", F.floor("rate")).withColumn("part", F.col("rate") - F.col("base"))
    run = "OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rated = stored(rated.withColumn("carried", F.expr(f"coalesce(sum(n * part) {run}, 0D)")), "mixing-rates")
    subs = rows.join(rated.selectExpr("source AS k", "size AS z", "subs"), F.col("source").eqNullSafe(F.col("k")) & (F.col("size") == F.col("z")))
    subs = subs.groupBy("source", "size", F.expr("pmod(h, subs)").alias("sub"), "h").agg(F.count("*").alias("same"))
    subs = stored(subs, "mixing-ranks")
    counts = subs.groupBy("source", "size", "sub").agg(F.sum("same").alias("m"))
    counts = counts.join(rated.selectExpr("source AS k", "size AS z", "source_size", "target", "base", "part", "carried", "subs"), F.col("source").eqNullSafe(F.col("k")) & (F.col("size") == F.col("z"))).drop("k", "z")
    run = "OVER (PARTITION BY source, size ORDER BY sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    counts = counts.withColumn("start", F.expr(f"carried + coalesce(sum(m * part) {run}, 0D)"))
    counts = counts.withColumn("extra", F.expr("floor(start + m * part + 0.5D) - floor(start + 0.5D)"))
    ranks = subs.withColumn("upto", F.expr("sum(same) OVER (PARTITION BY source, size, sub ORDER BY h)"))
    chosen = ranks.join(counts.selectExpr("source AS k", "size AS z", "sub AS u", "extra"), F.col("source").eqNullSafe(F.col("k")) & (F.col("size") == F.col("z")) & (F.col("sub") == F.col("u")))
    below = chosen.where("upto <= extra").groupBy("source", "size", "sub").agg(F.max("h").alias("below"))
    below = below.selectExpr("source AS k", "size AS z", "sub AS u", "below")
    out = counts.join(below, F.col("source").eqNullSafe(F.col("k")) & (F.col("size") == F.col("z")) & (F.col("sub") == F.col("u")), "left")
    return stored(out.select("source", "size", "sub", "subs", "source_size", "target", "base", "below"), "mixing-copies")


def with_copies(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows (source, size, h, ...) with source_size, target and the number of copies."""
    d = decided.selectExpr("source AS k", "size AS z", "sub AS u", "source_size", "target", "base", "below")
    subs = decided.groupBy("source", "size").agg(F.max("subs").alias("subs")).selectExpr("source AS k2", "size AS z2", "subs")
    rows = rows.join(subs, F.col("source").eqNullSafe(F.col("k2")) & (F.col("size") == F.col("z2"))).withColumn("u0", F.expr("pmod(h, subs)"))
    rows = rows.join(d, F.col("source").eqNullSafe(F.col("k")) & (F.col("size") == F.col("z")) & (F.col("u0") == F.col("u")))
    return rows.withColumn("copies", F.expr("cast(base + CASE WHEN h <= below THEN 1 ELSE 0 END AS long)")).drop("k", "z", "u", "k2", "z2", "u0", "subs", "base", "below")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document; taken = copies * size.

    Null and blank texts have size 0 and are taken once. A null source is one source, ranked last. Repeated doc_ids
    of one source and size share their fate; reruns agree, as the order is a hash of doc_id. An empty table gives none.
    """
    rows = stored(keyed(docs), "mixing-documents")
    out = with_copies(rows, copies(rows, weights, most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The mixed documents, columns as they came: each row as often as it is taken."""
    rows = stored(keyed(docs), "mixing-documents")
    decided = copies(rows, weights, most)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    packed = packed.select("row", F.col("row.source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(10), F.col("row.doc_id").cast("long")).alias("h"))
    out = with_copies(packed, decided).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
