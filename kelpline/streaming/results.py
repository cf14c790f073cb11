"""Results of an experiment that arrive as a stream, kept so that a run which stops goes on where it was.

Each batch is a folder of its own, named by its epoch. Spark runs a batch again, with the same
epoch and rows, where it can't tell whether it was finished; it then replaces its own folder, so
that a replayed batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiments as E

KEY = ["question", "codebase", "condition"]


def save_batch(rows: DataFrame, epoch: int, path: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def record(trials: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in what a stream of trials has and ends."""
    trials.writeStream.foreachBatch(lambda rows, epoch: save_batch(rows, epoch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def recorded(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of trials that were recorded (none where nothing is yet). Of a trial that a restarted run sent again, in a later epoch, the last epoch's rows count."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + ["epoch bigint"]
    rows = spark.read.schema(", ".join(fields)).option("ignoreMissingFiles", True).parquet(path)
    last = rows.groupBy(*KEY, "trial").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, [*KEY, "trial", "epoch"], "left_semi").drop("epoch")


def finished(trials: DataFrame, wanted: int, least: int = 3) -> DataFrame:
    """question, codebase, condition, trials, done: as many trials as wanted, or least or more that all have one list of verdicts (where smart runs stop early)."""
    per = trials.groupBy(*KEY).agg(F.countDistinct("trial").alias("trials"))
    # An early stop is looked for in each codebase by itself.
    own = trials.withColumn("question", F.struct("codebase", "question"))
    stopped = E.early_stop(own, least).select(F.col("question.question").alias("question"), F.col("question.codebase").alias("codebase"), "condition", F.lit(True).alias("_stopped"))
    return per.join(stopped, KEY, "left").select(*KEY, "trials", ((F.col("trials") >= wanted) | F.coalesce("_stopped", F.lit(False))).alias("done"))


def left_over(wanted: DataFrame, done: DataFrame, trials: int) -> DataFrame:
    """question, codebase, condition, first: what of wanted (rows of finished() tell what is done) is still to run, and the number of its first missing trial, from 1."""
    rest = E.remaining(wanted, done)
    return rest.join(done.select(*KEY, "trials"), KEY, "left").select(*KEY, (F.coalesce("trials", F.lit(0)) + 1).alias("first")).where(F.col("first") <= trials)
