"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir), or where that is unset and Spark runs in one process, as in tests, a new local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="kelpline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """Cuts lineage: runs df once and keeps its rows in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Shuffle files go at the end of a write: its table is all that is read later.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, folder: str | None = None) -> DataFrame:
    """As settled(), as a Parquet table in the shared folder, whose size the optimizer knows: it broadcasts what is small, and shuffles what isn't."""
    spark = df.sparkSession
    path = folder or f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def grows(df: DataFrame) -> DataFrame:
    """df, a side of a join that grows with the tables: no join sends it through the driver, however small its packed file is."""
    return df.hint("merge")


#: Rows that one task sorts or groups, about.
TASK_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """So many partitions that a task's rows stay about as many however many there are; the shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt by keys to so many tasks, where they are more than the shuffle partitions; fewer are left to adaptive execution."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def in_ranges(df: DataFrame, *order: str, each: int = TASK_ROWS) -> DataFrame:
    """df dealt by ranges of columns order, written once, with _range; what is in one is in one task, and there are more ranges where there are more rows."""
    spark = df.sparkSession
    df = settled(df)
    return settled(df.repartitionByRange(tasks_for(spark, df.count(), each), *order).withColumn("_range", F.spark_partition_id()))


def row_numbers(df: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """df with each row's number in its group, from 1, by columns order.

    No task numbers a group alone: rows are dealt by ranges of group and order, and each range
    starts where those before it end.
    """
    dealt = in_ranges(df, *group, *order)
    dealt = spread(dealt, dealt.rdd.getNumPartitions(), *group, "_range")
    sizes = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).drop("_n").withColumnsRenamed({g: f"_{i}" for i, g in enumerate(group)})
    own = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    same = dealt["_range"] == sizes["_range"]
    for i, g in enumerate(group):
        same = same & dealt[g].eqNullSafe(sizes[f"_{i}"])
    rows = dealt.join(sizes, same, "left").drop(sizes["_range"])
    return rows.withColumn(name, (own + F.col("_before")).cast("long")).drop("_range", "_before", *[f"_{i}" for i in range(len(group))])
