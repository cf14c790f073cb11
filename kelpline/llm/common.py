"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every word rule here: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For Python: bytes.translate() lower-cases A-Z alone, which leaves UTF-8 sequences as they are.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, the first of each; all else is dropped.

    Other columns may clash with them in case or be there twice: columns are found by
    position, so neither is ambiguous. A missing column raises ValueError.
    """
    at = []
    for name in names:
        if name not in df.columns:
            raise ValueError(f"no column {name!r}; there are {df.columns}")
        at.append(df.columns.index(name))
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select([F.col(f"_{i}").alias(name) for i, name in zip(at, names)])


def lower_az(col):
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; where that is unset and Spark runs in one process, as in tests, a new local one."""
    sc = spark.sparkContext
    has = sc._jsc.sc().getCheckpointDir()
    if has.isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="kelpline-"))
        has = sc._jsc.sc().getCheckpointDir()
    return has.get()


def settled(df: DataFrame) -> DataFrame:
    """Cuts lineage: runs df once and keeps its rows in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared folder; nothing is there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle files go at the end of a write: its table is all that is read later.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """As settled(), as a Parquet table: columns can be read apart, and it takes less room."""
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else new_folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Gives written() into a folder of its own; drop() removes tables that nothing lazy reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, new_folder(spark, "scratch")

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.folder)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A Scratch whose folder goes at the end of the block; nothing lazy may read it then."""
    keep = Scratch(spark)
    try:
        yield keep
    finally:
        remove(spark, keep.folder)


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs (with doc_id and text) without the rows that decided (doc_id, text_hash, kept; a row for each) drops.

    text_hash is xxhash64 of the text. Of rows with equal id and text of which one stays, one does.
    """
    decided = settled(decided.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "kept"))
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    fates = decided.join(decided.where("not kept").select(F.col("_id").alias("_i"), F.col("_h").alias("_k")).distinct(), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_k")), "left_semi")
    fates = settled(fates.groupBy("_id", "_h").agg(F.max("kept").alias("some")))
    gone, again = fates.where("not some"), fates.where("some")
    out = keyed.join(gone, match, "left_anti")
    if not again.isEmpty():
        one = Window.partitionBy("doc_id", "_hash").orderBy("text")
        repeated = out.join(again, match, "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
        out = out.join(again, match, "left_anti").unionByName(repeated)
    return out.drop("_hash")
