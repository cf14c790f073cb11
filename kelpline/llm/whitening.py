"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Entries become whole numbers, so counts, sums and deviations are exact. Each task folds its
vectors into a summary: their number, exact sums, mean, and all singular values and right
vectors of the centred rows. Two summaries merge without loss: both sets of scaled vectors and a
row of the weighted difference of the means are decomposed again, and no dimension is dropped.
Tasks send one summary each; summaries are merged FAN_IN at a time, level by level, so that no
task and not the driver reads more than FAN_IN of them. The last one is the model: of the size of
a dimension squared, whatever the number of rows.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped, and
so are those of another length than most of the rest have (the longer of lengths as frequent) and
empty ones; vectors that repeat count once in the fit and are returned each; whole numbers beyond
2^53 are held at it; a component without variance has null for whitened, and nothing has variance
in a fit of one vector; a deviation beyond 64 bits is null; fewer dimensions than components give
as many as there are; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, scratch, table, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Summaries that one task merges, and rows that are decomposed at once.
FAN_IN, ROWS = 8, 2048
LIMIT = 1 << 53
SUMMARY = "n long, sums array<string>, mean array<double>, scaled array<double>"
SUMMARY_NAMES = [x.split()[0] for x in SUMMARY.split(", ")]
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def scaled_rows(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, x (array<long>) of the rows whose entries are all finite, of one length."""
    of = pick(vectors, id_column, vector_column).toDF("id", "v").where(F.col("v").isNotNull() & (F.size("v") > 0))
    # NaN and the infinities alone give no zero when they are multiplied by it; null gives null.
    of = of.where(F.forall("v", lambda c: F.coalesce(c.cast("double") * F.lit(0.0) == 0.0, F.lit(False))))
    most = of.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    of = of.where(F.size("v") == (most.d if most else 0))
    held = lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(-float(LIMIT))), F.lit(float(LIMIT)))
    return of.select(F.col("id").cast("long"), F.transform("v", lambda c: held(c).cast("long") + F.lit(OFFSET)).alias("x"))


@dataclass
class Summary:
    """Of n rows: exact sums, mean less OFFSET, and R with R'R the centred rows' products: singular values times right vectors, in order."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scaled: np.ndarray

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        step = other.mean - self.mean
        correction = np.sqrt(self.n / n * other.n) * step
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums)], self.mean + step * (other.n / n), decomposed(np.vstack([self.scaled, other.scaled, correction])))


def decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors: as many rows as dimensions, zeros included."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    out = np.zeros((rows.shape[1], rows.shape[1]))
    out[: len(s)] = s[:, None] * v
    return out


def total(x: np.ndarray) -> list[int]:
    """Exact sums of columns."""
    if np.abs(x).max() < (1 << 62) // len(x):
        return [int(v) for v in x.sum(axis=0)]
    return [int(v) for v in x.astype(object).sum(axis=0)]


def summarised(x: np.ndarray) -> Summary:
    sums = total(x)
    mean = np.array([(s - OFFSET * len(x)) / len(x) for s in sums])
    return Summary(len(x), sums, mean, decomposed((x - OFFSET).astype(np.float64) - mean))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _row(s: Summary) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": [s.n], "sums": [[str(v) for v in s.sums]], "mean": [s.mean], "scaled": [s.scaled.ravel()]})


def _read(batch: pa.RecordBatch) -> Iterator[Summary]:
    for n, sums, mean, scaled in zip(*(c.to_pylist() for c in batch.columns)):
        yield Summary(n, [int(v) for v in sums], np.array(mean), np.array(scaled).reshape(len(mean), -1))


def fold(parts: Iterator[Summary]) -> Summary | None:
    out = None
    for part in parts:
        out = part if out is None else out.merged(part)
    return out


def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One summary of a task's rows."""
    found = fold(summarised(matrix(b.column(0).slice(i, ROWS))) for b in batches for i in range(0, b.num_rows, ROWS))
    if found:
        yield _row(found)


def merges(group: pa.Table) -> pa.Table:
    """The FAN_IN summaries, at most, that share a place one level up."""
    return pa.Table.from_batches([_row(fold(s for b in group.select(SUMMARY_NAMES).to_batches() for s in _read(b)))])


def whole(level: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> Summary | None:
    """Merges tasks' summaries, FAN_IN a task, until one is left."""
    level, depth = keep(level.withColumn("at", F.spark_partition_id()), "level_0"), 0
    while level.count() > 1:
        depth += 1
        up = level.withColumn("at", F.expr(f"at div {FAN_IN}").cast("int"))
        level = keep(up.groupBy("at").applyInArrow(lambda key, group: merges(group).append_column("at", pa.array([key[0].as_py()], pa.int32())), f"{SUMMARY}, at int"), f"level_{depth}")
    last = level.select(*SUMMARY_NAMES).first()
    return Summary(last.n, [int(v) for v in last.sums], np.array(last.mean), np.array(last.scaled).reshape(len(last.mean), -1)) if last else None


class Whitener:
    """The first components of a fit, applied to whole-number vectors."""

    def __init__(self, fit: Summary, components: int = COMPONENTS) -> None:
        _, s, v = np.linalg.svd(fit.scaled)
        self.n, self.sums = fit.n, fit.sums
        self.k = min(components, len(s))
        variance = s * s / fit.n
        #: Of rounding alone a component gets so much.
        self.some = s[: self.k] > s[0] * len(s) * 8 * np.finfo(float).eps
        self.directions = v[: self.k].T
        self.root = np.sqrt(np.where(self.some, variance[: self.k], 1.0))
        self.explained = [float(e / variance.sum()) if variance.sum() > 0 else None for e in variance[: self.k]]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: of 64 bits where these suffice, else Python's numbers."""
        most = max(int(np.abs(x).max()) * self.n, max(abs(s) for s in self.sums)) if x.size else 0
        if most < 1 << 61:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        if centred.dtype != object and centred.size:
            most = int(np.abs(centred).max())
            if most * most * centred.shape[1] < 1 << 63:
                return (centred * centred).sum(axis=1).tolist()
        found = [sum(int(v) ** 2 for v in row) for row in centred]
        return [v if v < 1 << 63 else None for v in found]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows by components; nan where a component has no variance."""
        out = (centred.astype(np.float64) / self.n) @ self.directions / self.root
        return np.where(self.some, out, np.nan)


def identity_error(rows: DataFrame, model: Whitener) -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, over the components that have variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = fold(moments(model.whitened(model.centred(matrix(b.column(0).slice(i, ROWS))))[:, model.some]) for b in batches for i in range(0, b.num_rows, ROWS))
        if found:
            yield _row(found)

    def moments(w: np.ndarray) -> Summary:
        mean = w.mean(axis=0)
        return Summary(len(w), [0] * w.shape[1], mean, decomposed(w - mean))

    if not model.some.any():
        return None
    with scratch(rows.sparkSession) as keep:
        all_rows = whole(rows.select("x").mapInArrow(run, SUMMARY), keep)
    covariance = all_rows.scaled.T @ all_rows.scaled / all_rows.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """OUT and identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    schema = f"{OUT}, identity_error double"
    with scratch(spark) as keep:
        rows = keep(scaled_rows(vectors, id_column, vector_column), "rows")
        distinct = keep(rows.select("x").distinct(), "distinct")
        fit = whole(distinct.mapInArrow(leaves, SUMMARY), keep)
        if fit is None:
            return spark.createDataFrame([], schema)
        model = Whitener(fit, components)
        error = identity_error(distinct, model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in schema.split(", ")]
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    n, k = part.num_rows, model.k
                    centred = model.centred(matrix(part.column(1)))
                    each = lambda values, kind: pa.array(values, kind).take(pa.array(np.repeat(np.arange(n), k)))
                    whitened = model.whitened(centred).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), each(model.deviation(centred), pa.int64()),
                            pa.array(whitened, mask=np.isnan(whitened)), pa.array(model.explained * n, pa.float64()), pa.array([error] * (n * k), pa.float64()),
                        ],
                        names=names,
                    )

        return written(rows.mapInArrow(run, schema), "whitened")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
