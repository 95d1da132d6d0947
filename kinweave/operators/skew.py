"""Helpers for groups that hold a large share of all rows, and for cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window as W, functions as F

# A key is heavy when it holds more than 1/SHARE of all rows, so there are fewer
# than SHARE heavy keys whatever the data: that bound is what allows a broadcast.
SHARE = 256
# Into so many parts the left rows of a heavy key are dealt in a join.
PARTS = 64
# Tables that this driver has written and not yet deleted.
_WRITTEN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a temporary one only for local runs."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Write a table to the shared folder and continue from there; also its number of rows.

    Later stages read only the columns they need, know the size of the table, and
    survive the loss of executors without recomputing what came before.
    """
    path = f"{shared_folder(df.sparkSession)}/kinweave-{uuid.uuid4().hex}"
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _WRITTEN.add(path)
    return out, rows.get["n"]


def cut(df: DataFrame) -> DataFrame:
    return cut_counted(df)[0]


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    _WRITTEN.discard(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table that :func:`cut` has written; nothing that reads it may run afterwards."""
    if path := getattr(df, "_cut_path", None):
        _delete(df.sparkSession, path)


def tidy(spark: SparkSession) -> int:
    """Delete all tables that :func:`cut` has written, once the results that read them are stored; says how many."""
    found = sorted(_WRITTEN)
    for path in found:
        _delete(spark, path)
    return len(found)


@atexit.register
def _tidy_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _WRITTEN else None
    if spark is not None and spark.sparkContext._jsc is not None:
        tidy(spark)


def join_counted(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
    count: str = "n", total: int | None = None, share: int = SHARE, parts: int = PARTS,
) -> DataFrame:
    """Join with a table of one row per key that also counts the left rows of the key.

    Heavy keys are salted: their left rows are dealt into ``parts`` by the hash of all
    columns, their one right row is repeated as often, and a single shuffle join serves
    heavy and light keys alike, whatever the size of the tables. ``right`` is read twice,
    so materialise it where it is costly. ``total`` is the number of left rows where the
    caller knows it.
    """
    size = F.lit(total) if total is not None else right.agg(F.sum(count)).scalar()
    right = right.withColumn("_heavy", F.col(count) * share > size)
    # Fewer than ``share`` rows by construction, and the key columns only.
    listed = right.where("_heavy").select(*on, "_heavy")
    dealt = left.join(F.broadcast(listed), on, "left").withColumn(
        "_salt", F.when(F.col("_heavy"), F.pmod(F.xxhash64(*left.columns), F.lit(parts))).otherwise(0).cast("long")
    ).drop("_heavy")
    repeated = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_heavy"), parts - 1).otherwise(0).cast("long")))
    ).drop(count, "_heavy")
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")


def position_within(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``position``: the 0-based place of each row in the order of its group.

    Exact and without sorting a group in one task: rows are cut into key ranges,
    each range is ranked on its own and shifted by the sizes of the earlier ones.
    """
    ranged = cut(
        df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn("_slice", F.spark_partition_id())
    )
    sizes = ranged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        ranged.join(shifts, [*keys, "_slice"])
        .withColumn("position", F.row_number().over(inside) + F.col("_shift") - 1)
        .drop("_slice", "_shift")
    )
