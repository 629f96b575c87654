"""Shared folder, stored tables and gapless numbering for the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: `[\x20\x09-\x0D]`: what counts as white space in every operator here.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one of our own only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return base or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, used once: a retried job never meets another's files."""
    return f"{shared_folder(spark).rstrip('/')}/tidemill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, and later jobs do not compute it again."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Hadoop's file system, wherever it lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; every other character stays, unlike ``lower``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words_of(text: Column) -> Column:
    """Array of the runs `[^\x20\x09-\x0D]+` of a text; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN, -1))


def gapless(df: DataFrame, group: list[str], order: list[str], out: str, rows_a_bucket: int = 20_000) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each group, in no promised order.

    A group may hold a third of all rows, so it is numbered in hash buckets of its own: the rows of a bucket
    are numbered in one task, and a bucket's base is the prefix sum of the counts of those before it. ``df``
    is read twice, so it should be a stored table. Rows equal in ``order`` get different numbers.
    """
    total = df.count()
    buckets = max(1, -(-total // rows_a_bucket))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    numbered = dealt.withColumn("_i", F.row_number().over(inside))
    match = numbered["_b"] == base["_gb"]
    for i, g in enumerate(group):
        match &= numbered[g].eqNullSafe(base[f"_g{i}"])
    keep = [numbered[c] for c in df.columns]
    return numbered.join(base, match).select(*keep, (F.col("_base") + F.col("_i") - 1).cast("long").alias(out))
