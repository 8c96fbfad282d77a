"""Helpers shared by the operators: text conventions, written intermediates and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import scratch_dir

#: white space that separates words; everything else belongs to a word
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a frame below the shared folder and reads it back: it is computed once, survives lost executors
    and has a known size."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these frames. Only for frames that nothing reads any more: everything made from them has been
    written itself."""
    for df in frames:
        files = df.inputFiles()
        if files:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(edges: DataFrame, purpose: str = "components", tidy: bool = False) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root being the smallest node reached.

    Alternates large-star and small-star rounds, in which every node points its neighbours to the smallest
    one, until all edges lead straight to a root. A round is two aggregations and joins; no neighbourhood is collected. Self
    loops are ignored; nodes without another edge do not appear. ``tidy`` deletes a round's edges once the next round's are written.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose
    )
    while not rooted(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b")  # no more rows than edges; repeats go at the round's end
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, stored(small, purpose)
        if tidy:
            discard(before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b) lead from each node to one other at most, from which none leads on. Another round would leave them as
    they are."""
    ends = F.array(*(F.struct(F.col(c).alias("node"), F.lit(int(c == "a")).alias("out"), F.lit(int(c == "b")).alias("met")) for c in "ab"))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met"))
    return nodes.where("out + met > 1 AND out > 0").agg(F.count("*")).first()[0] == 0
