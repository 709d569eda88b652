"""Sinks: sharded tables with an index, JSON lines, light indexes, manifests of written files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import top_k


def sharded(df: DataFrame, path: str, shard: str, order: list[Column], files_per_shard: int = 1) -> DataFrame:
    """Write one folder per shard, rows in order within a file, and return the index (shard, n).

    A shard's rows are spread over files_per_shard tasks by a hash, so that a large shard is not one task's work.
    """
    spread = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard)))
    spread.repartition(F.col(shard), F.col("__part")).drop("__part").sortWithinPartitions(shard, *order).write.partitionBy(shard).parquet(path)
    return df.groupBy(shard).agg(F.count("*").alias("n"))


def shard_index(df: DataFrame, shard: str, key: str, order: list[Column], counts: dict[str, Column], preview: int = 30) -> DataFrame:
    """One row per shard: n, a count of rows for each named condition, and the keys of its first `preview` rows in order."""
    totals = df.groupBy(shard).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in counts.items()])
    first = top_k(df, [shard], order, preview).groupBy(shard).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("key")))).alias("first"))
    return totals.join(first.select(shard, F.transform("first", lambda x: x["key"]).alias("preview")), shard)


def recent_slice(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows of the `days` days that end with the newest row; the newest date is one row, joined in the plan."""
    newest = df.agg(F.max(date).alias("newest_"))
    return df.join(F.broadcast(newest), F.col(date) >= F.col("newest_") - F.make_interval(days=F.lit(days))).drop("newest_")


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def light_index(df: DataFrame, fields: list[str], lists: dict[str, int]) -> DataFrame:
    """The named fields, and list fields cut to their first n non-empty entries."""
    cut = [F.slice(F.filter(F.col(c), lambda x: x.isNotNull() & (x != "")), 1, n).alias(c) for c, n in lists.items()]
    return df.select(*fields, *cut)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_problems(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem): files that differ from the manifest, are missing, or are not listed."""
    m = manifest.select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    j = now.join(m, "path", "full_outer")
    problem = F.when(F.col("s").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when((F.col("s") != F.col("sha256")) | (F.col("b") != F.col("bytes")), "differs")
    return j.select("path", problem.alias("problem")).where("problem is not null")
