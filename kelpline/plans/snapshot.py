"""Snapshots of a graph and its analysis, and what is asked of one file.

A snapshot's tables are Parquet in a folder of their own version. The manifest, a small text that
names the version, is put in place last and at once, so a reader finds one version whole: that
before or that after. Versions that readers may still hold stay until prune(). A table with a key
is clustered by it, so the rows of one file are found by Parquet's statistics.
"""

from __future__ import annotations

import datetime
import json
import os
import subprocess
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, profile

VERSION, MANIFEST = 2, "manifest.json"
#: The column by which a table's rows are asked for.
KEYS = {"nodes": "id", "edges": "dst", "risk": "node", "churn": "path", "tests": "node"}


class SnapshotError(ValueError):
    """There is no snapshot, or it can't be read."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """At once: written beside its place, then renamed over what is there."""
    jvm, at, fs = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(part, at, options)


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame], head: str | None = None, keys: dict[str, str] | None = None) -> None:
    """A new version of tables, clustered by keys (KEYS, if none are given). Tables may be derived from the version before."""
    folder, keys = f"v-{uuid.uuid4().hex}", KEYS if keys is None else keys
    for name, df in tables.items():
        key = keys.get(name)
        if key in df.columns:
            df = df.repartitionByRange(key).sortWithinPartitions(key)
        df.write.parquet(f"{path}/{folder}/{name}")
    made = {"version": VERSION, "generated": datetime.datetime.now(datetime.timezone.utc).isoformat(), "head": head, "folder": folder, "tables": list(tables)}
    _put(spark, f"{path}/{MANIFEST}", json.dumps(made))


def manifest(spark: SparkSession, path: str) -> dict:
    jvm, at, fs = _fs(spark, f"{path}/{MANIFEST}")
    if not fs.exists(at):
        raise SnapshotError(f"no snapshot in {path}")
    rows = spark.read.text(f"{path}/{MANIFEST}", wholetext=True).collect()
    try:
        found = json.loads(rows[0].value)
        version = found["version"]
    except (IndexError, KeyError, TypeError, ValueError) as e:
        raise SnapshotError(f"the manifest in {path} is broken; write the snapshot again") from e
    if version != VERSION:
        raise SnapshotError(f"snapshot version {version}, {VERSION} is needed; write the snapshot again")
    return found


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of one version."""
    found = manifest(spark, path)
    return {name: spark.read.parquet(f"{path}/{found['folder']}/{name}") for name in found["tables"]}


def prune(spark: SparkSession, path: str) -> int:
    """Removes versions other than the present one, which no reader may be using any more; how many."""
    now, gone = manifest(spark, path)["folder"], 0
    jvm, at, fs = _fs(spark, path)
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("v-") and name != now:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def find(start: str, name: str = ".kelpline") -> str | None:
    """The snapshot's folder in start or the nearest folder above it, up to the repository's root."""
    here = Path(start).resolve()
    for f in [here, *here.parents]:
        if (f / name / MANIFEST).exists():
            return str(f / name)
        if (f / ".git").exists():
            return None
    return None


def write_text(text: str, path: str) -> None:
    """At once: a reader sees the text before or after, never half of it."""
    part = f"{path}.tmp"
    Path(part).write_text(text)
    os.replace(part, path)


def is_stale(spark: SparkSession, path: str, head: str | None) -> bool:
    return manifest(spark, path)["head"] != head


def staleness(spark: SparkSession, path: str, root: str, timeout: int = 15) -> str | None:
    """A warning with the number of commits since the snapshot, or null if there are none, it has no head or root is no repository."""
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, timeout=timeout, check=True).stdout.strip()
    head = manifest(spark, path)["head"]
    try:
        if not head or git("rev-parse", "HEAD").startswith(head):
            return None
    except (OSError, subprocess.SubprocessError):
        return None
    try:
        return f"\u26a0 snapshot generated before {int(git('rev-list', '--count', f'{head}..HEAD'))} commits \u2014 write it again to refresh"
    except (OSError, ValueError, subprocess.SubprocessError):
        return "\u26a0 snapshot may be stale \u2014 write it again to refresh"


def analysed(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The tables that point queries ask for: nodes, edges and every file's risk."""
    return {"nodes": nodes, "edges": edges, "risk": graph.blast_radius(nodes, edges)}


def blast_radius(tables: dict[str, DataFrame], file: str) -> DataFrame:
    """profile.blast_radius_of() for one file: the stored risk, read by its key, and a search from that file alone for the path of the longest cascade.

    A file whose risk isn't stored is searched for; zeros if none depends on it.
    """
    spark = tables["nodes"].sparkSession
    asked = spark.createDataFrame([(file,)], "id string")
    stored = tables["risk"].where(F.col("node") == file)
    if stored.isEmpty():
        return profile.blast_radius_of(asked, tables["nodes"], tables["edges"])
    ways = graph.cascade_paths(tables["edges"], tables["nodes"], asked).select(F.col("root").alias("node"), "path")
    return stored.drop("weighted").join(ways, "node", "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def test_map(tables: dict[str, DataFrame], file: str) -> DataFrame:
    """profile.tests_by_file() for one file; a file that no test reaches has empty lists."""
    spark = tables["nodes"].sparkSession
    asked = spark.createDataFrame([(file,)], "id string")
    found = profile.tests_by_file(graph.test_map(tables["edges"], tables["nodes"], asked))
    return profile.with_no_tests(asked.select(F.col("id").alias("node")).join(found, "node", "left"))
