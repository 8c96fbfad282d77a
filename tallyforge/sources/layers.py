"""Layered storage: bronze, silver, quarantine, audit and gold tables as versioned folders.

A write goes to a new version folder and counts once its success marker is there, so a job may
read a table it replaces, a lost job leaves the last version in place, and a rerun is harmless.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.latest import latest_by


def _folder(spark: SparkSession, path: str):
    """A path of the store and its file system."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def complete(spark: SparkSession, path: str, name: str, only: bool = True) -> list[int]:
    """The numbers n of the folders ``name=n`` below a path, ascending; ``only`` those whose writing ended."""
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        entry = status.getPath()
        key, _, number = entry.getName().partition("=")
        if key == name and number.isdigit() and (not only or fs.exists(_folder(spark, f"{path}/{entry.getName()}/_SUCCESS")[0])):
            found.append(int(number))
    return sorted(found)


def remove(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)


def same_keys(df: DataFrame, keys: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Rows of ``df`` whose key is listed (left_semi) or not (left_anti); NULL equals NULL."""
    listed = keys.select(*[F.col(c).alias(f"_key_{c}") for c in by]).distinct()
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return df.join(listed, match, how)


@dataclass
class Buckets:
    """Which version holds each bucket of a table that is changed by key."""

    by: list[str]
    count: int
    schema: T.StructType
    versions: dict[int, int] = field(default_factory=dict)

    def of(self, *columns: Column | str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.count)).cast("int")


@dataclass(frozen=True)
class Lakehouse:
    spark: SparkSession
    root: str
    fmt: str = "parquet"

    def path(self, layer: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{name}"

    def _versions(self, layer: str, name: str, complete_only: bool = True) -> list[int]:
        return complete(self.spark, self.path(layer, name), "v", complete_only)

    def write(
        self,
        df: DataFrame,
        layer: str,
        name: str,
        partition_by: tuple[str, ...] = (),
        cluster: bool = False,
        **options: str,
    ) -> str:
        """Replaces a table, optionally in one folder per ``partition_by`` value; ``options`` are the writer's. Returns the
        folder of the new version."""
        taken = self._versions(layer, name, complete_only=False)
        target = f"{self.path(layer, name)}/v={(taken[-1] if taken else 0) + 1:06d}"
        if cluster:
            # one shuffle on the folder columns: few files per folder, and a folder that is much
            # larger than the others is still written by several tasks
            df = df.hint("rebalance", *partition_by)
        writer = df.write.format(self.fmt).mode("errorifexists").options(**options)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(target)
        return target

    def read(self, layer: str, name: str) -> DataFrame | None:
        """The last complete version; None where there is none, or where it holds no rows."""
        versions = self._versions(layer, name)
        if not versions:
            return None
        buckets = self._buckets(layer, name, versions[-1])
        if buckets:
            return self._read_buckets(layer, name, buckets, buckets.versions)
        df = self.spark.read.format(self.fmt).load(f"{self.path(layer, name)}/v={versions[-1]:06d}")
        return None if df.isEmpty() else df

    def _buckets(self, layer: str, name: str, version: int) -> Buckets | None:
        folder = f"{self.path(layer, name)}/_buckets"
        if version not in complete(self.spark, folder, "v"):
            return None
        rows = self.spark.read.parquet(f"{folder}/v={version}").collect()  # one row a bucket
        schema = T.StructType.fromJson(json.loads(rows[0].schema))
        return Buckets(list(rows[0].by), rows[0].count_, schema, {r.bucket: r.version for r in rows})

    def _read_buckets(self, layer: str, name: str, buckets: Buckets, chosen: Iterable[int]) -> DataFrame | None:
        """Some buckets of a table; columns that a bucket was written without are NULL."""
        folders = []
        wanted = set(chosen)
        for version in sorted({buckets.versions[b] for b in wanted}):
            root = f"{self.path(layer, name)}/v={version:06d}"
            there = set(complete(self.spark, root, "_bucket", only=False))
            folders += [f"{root}/_bucket={b}" for b in sorted(there & wanted) if buckets.versions[b] == version]
        return self.spark.read.schema(buckets.schema).format(self.fmt).load(folders) if folders else None

    def _touched(self, buckets: Buckets, keys: DataFrame) -> list[int]:
        # numbers of buckets, of which there is a fixed number
        return [r.b for r in keys.select(buckets.of(*buckets.by).alias("b")).distinct().collect()]

    def read_keys(self, layer: str, name: str, keys: DataFrame, by: Sequence[str]) -> DataFrame | None:
        """Rows with the listed keys. Of a table changed by these keys only their buckets are opened."""
        versions = self._versions(layer, name)
        buckets = self._buckets(layer, name, versions[-1]) if versions else None
        if buckets and buckets.by == list(by):
            df = self._read_buckets(layer, name, buckets, self._touched(buckets, keys))
        else:
            df = self.read(layer, name)
        return None if df is None else same_keys(df, keys, by, "left_semi")

    def replace_keys(
        self, layer: str, name: str, keys: DataFrame, rows: DataFrame, by: Sequence[str], buckets: int = 64
    ) -> list[int]:
        """Removes all rows with the listed keys and adds ``rows``, whose keys must be among them. Returns the buckets written.

        Copy-on-write: rows lie in folders by the hash of their key; a change writes new files for the buckets it touches
        and a list that says which version holds each bucket. The list is written first and counts once the new version is
        complete, so readers see the table before or after the change, and a lost job leaves it as it was. The first change of a
        table that was written whole lays out all buckets; ``buckets`` counts then.
        """
        path, taken = self.path(layer, name), self._versions(layer, name, complete_only=False)
        done = self._versions(layer, name)
        version = (taken[-1] if taken else 0) + 1
        old = self._buckets(layer, name, done[-1]) if done else None
        if old and old.by != list(by):
            raise ValueError(f"{layer}/{name} is changed by {old.by}, not by {list(by)}")
        if old:
            touched = self._touched(old, keys)
            current = self._read_buckets(layer, name, old, touched)
        else:
            touched, current = list(range(buckets)), self.read(layer, name)
        if not touched:
            return []
        kept = current if current is None else same_keys(current, keys, by, "left_anti")
        if old and kept is None:
            kept = self.spark.createDataFrame([], old.schema)
        merged = rows if kept is None else kept.unionByName(rows, allowMissingColumns=True)
        new = Buckets(list(by), old.count if old else buckets, merged.schema, {**(old.versions if old else {}), **dict.fromkeys(touched, version)})
        schema = json.dumps(new.schema.jsonValue())
        entries = [(b, v, new.by, new.count, schema) for b, v in new.versions.items()]
        listed = self.spark.createDataFrame(entries, "bucket int, version int, by array<string>, count_ int, schema string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/_buckets/v={version}")
        dealt = merged.withColumn("_bucket", new.of(*by)).hint("rebalance", "_bucket")
        dealt.write.format(self.fmt).mode("errorifexists").partitionBy("_bucket").save(f"{path}/v={version:06d}")
        return sorted(touched)

    def prune(self, layer: str, name: str, keep: int = 1) -> list[int]:
        """Deletes all but the newest ``keep`` complete versions, and returns them. Buckets that a newer version still
        refers to stay. Jobs that still read an older version fail, so prune when none runs."""
        if keep < 1:
            raise ValueError("the newest version stays")
        versions, path = self._versions(layer, name), self.path(layer, name)
        needed: dict[int, set[int]] = {}
        for version in versions[-keep:]:
            buckets = self._buckets(layer, name, version)
            for b, v in buckets.versions.items() if buckets else ():
                needed.setdefault(v, set()).add(b)
        gone = []
        for version in versions[:-keep]:
            folder = f"{path}/v={version:06d}"
            remove(self.spark, f"{path}/_buckets/v={version}")
            if version not in needed:
                remove(self.spark, folder)
                gone.append(version)
                continue
            for b in complete(self.spark, folder, "_bucket", only=False):
                if b not in needed[version]:
                    remove(self.spark, f"{folder}/_bucket={b}")
        return gone

    def prune_all(self, keep: int = 2) -> dict[str, list[int]]:
        """``prune`` for every versioned table of every layer; the batch run ends with it, so that versions do not pile up.
        The one before the newest stays for jobs that still read it."""
        pruned = {}
        for layer in ("bronze", "staged", "silver", "gold"):
            folder, fs = _folder(self.spark, f"{self.root.rstrip('/')}/{layer}")
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                name = status.getPath().getName()
                if old := self.prune(layer, name, keep):
                    pruned[f"{layer}/{name}"] = old
        return pruned

    def rewrite_runs(self, df: DataFrame, layer: str, name: str) -> None:
        """Replaces the runs that occur in ``df``, which may come from them: the rows are stored apart first."""
        copy = f"{self.path('staged', f'{layer}_{name}')}/{uuid.uuid4().hex}"
        df.write.format(self.fmt).save(copy)
        rows = self.spark.read.format(self.fmt).load(copy)
        writer = rows.write.format(self.fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("run_id").save(self.path(layer, name))
        remove(self.spark, copy)

    def append_run(self, df: DataFrame, layer: str, name: str, run_id: str) -> None:
        """Adds the rows of one run; repeating the run replaces its own rows only."""
        df.write.format(self.fmt).mode("overwrite").save(f"{self.path(layer, name)}/run_id={run_id}")

    def read_runs(self, layer: str, name: str) -> DataFrame | None:
        folder, fs = _folder(self.spark, self.path(layer, name))
        if not fs.exists(folder):
            return None
        return self.spark.read.format(self.fmt).option("basePath", self.path(layer, name)).load(
            self.path(layer, name)
        )

    def append_audit(self, entry: DataFrame, run_id: str) -> None:
        self.append_run(entry, "audit", "entries", run_id)

    def read_audit(self) -> DataFrame | None:
        """The newest entry of every table."""
        entries = self.read_runs("audit", "entries")
        if entries is None:
            return None
        return latest_by(entries, ["table_name"], ["timestamp", "run_id"]).drop("run_id")


def read_source(
    spark: SparkSession,
    location: str,
    fmt: str = "parquet",
    *,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 200,
    one_connection: bool = False,
    **options: str,
) -> DataFrame | None:
    """A source table from files, or over JDBC with ``location`` as the table name.

    JDBC reads are split on ``partition_column`` between ``bounds`` so that no single connection
    carries the whole table; a small table may ask for ``one_connection``. None stands for an empty source.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        reader = reader.option("dbtable", location)
        if not one_connection:
            if not (partition_column and bounds):
                raise ValueError("a JDBC read needs partition_column and bounds, or one_connection")
            reader = reader.options(
                partitionColumn=partition_column,
                lowerBound=bounds[0],
                upperBound=bounds[1],
                numPartitions=str(partitions),
            )
        df = reader.load()
    else:
        df = reader.load(location)
    return None if df.isEmpty() else df


def publish(df: DataFrame, name: str, prefix: str = "silver_", **jdbc: str) -> str:
    """Replaces a warehouse table: a catalog table, or over JDBC when a ``url`` is given.

    Every executor writes its own rows; decimals stay decimals and zoned times lose their zone.
    """
    plain = [
        F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes
    ]
    table, out = f"{prefix}{name}", df.select(*plain)
    if "url" in jdbc:
        out.write.format("jdbc").options(dbtable=table, **jdbc).mode("overwrite").save()
    else:
        out.write.mode("overwrite").saveAsTable(table)
    return table


def materialize(df: DataFrame, name: str, *cluster_by: str) -> DataFrame:
    """Stores a mart as a catalog table and returns it read back, free of its lineage.

    ``cluster_by`` columns are bucketed, so joins on them later need no shuffle.
    """
    writer = df.write.mode("overwrite")
    if cluster_by:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        writer = writer.bucketBy(buckets, *cluster_by).sortBy(*cluster_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
