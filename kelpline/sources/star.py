"""A code graph, its history and an experiment, derived from whole star tables.

part is the files, with their types and lines; lineitem links them: a part imports the smallest
part of all its orders, and the smallest second part. orders are commits, their lines' parts the
files changed. events are an experiment's trials: condition, question, verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import grows, table

# What a p_type stands for, and the folder its files are in.
TYPES = {"SMALL": ("test", "tests"), "LARGE": ("config", "conf"), "PROMO": ("api-route", "api"), "MEDIUM": ("route", "pages"), "ECONOMY": ("component", "ui"), "STANDARD": ("utility", "lib")}


def _by_type(i: int):
    return F.create_map(*[F.lit(x) for k, v in TYPES.items() for x in (k, v[i])])[F.col("p_type")]


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, type, lines, p_name, exports, methods, route, client."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))
    path = F.concat_ws("/", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), _by_type(1), F.concat(name, F.lit(".ts")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), path.alias("id"), _by_type(0).alias("type"), F.col("p_retailprice").cast("int").alias("lines"), "p_name", F.split("p_name", " ").alias("exports"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("GET"), F.lit("POST"))).otherwise(F.array(F.lit("DELETE"))).alias("methods"), F.concat(F.lit("/"), _by_type(1), F.lit("/"), F.col("p_partkey").cast("string")).alias("route"), (F.col("p_partkey") % 3 == 0).alias("client"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, t: part k imports part t."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    first = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    both = first.select(F.explode("p").alias("k"), F.get("p", F.lit(0)).alias("m1"), F.get("p", F.lit(1)).alias("m2"))
    least = both.groupBy("k").agg(F.min("m1").alias("a"), F.min("m2").alias("b"))
    return least.select("k", F.explode(F.array_distinct(F.array("a", "b"))).alias("t")).where("t < k")


def edges(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None) -> DataFrame:
    """src, dst, type (tests if the source is a test), ord (long: source, then target)."""
    nodes = parts(spark, sf_dir) if nodes is None else nodes
    src = nodes.select(F.col("ord").alias("k"), F.col("id").alias("src"), F.col("type").alias("_type"))
    dst = nodes.select(F.col("ord").alias("t"), F.col("id").alias("dst"))
    out = keys(spark, sf_dir).join(grows(src), "k").join(grows(dst), "t")
    return out.select("src", "dst", F.when(F.col("_type") == "test", "tests").otherwise("imports").alias("type"), (F.col("k") * 10_000_000_000 + F.col("t")).alias("ord"))


def own_commits(spark: SparkSession, sf_dir: str, nodes: DataFrame) -> DataFrame:
    """As commits(), with the parts' ids as paths."""
    return _told(_changes(spark, sf_dir, "l_partkey").join(grows(nodes.select(F.col("ord").alias("file"), "id")), "file"), F.col("id"))


def commits(spark: SparkSession, sf_dir: str, file: str = "l_partkey") -> DataFrame:
    """commit, date, message, path, added, removed: the lines of all orders."""
    return _told(_changes(spark, sf_dir, file), F.concat(F.lit("src/"), F.col("file").cast("string"), F.lit(".ts")))


def _changes(spark: SparkSession, sf_dir: str, file: str) -> DataFrame:
    """commit, file (a key), added, removed, date, priority; texts are made of them when all is joined."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("priority"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col(file).alias("file"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("removed"))
    return lines.join(grows(orders), "commit")


def _told(changes: DataFrame, path: Column) -> DataFrame:
    message = F.concat(F.lit("order "), F.col("commit").cast("string"), F.lit(" "), F.col("priority"))
    return changes.select("commit", "date", message.alias("message"), path.alias("path"), "added", "removed")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """condition, condition_name, codebase, question, assertion, trial, verdict, latency, tools, tokens_in, tokens_out, ts: the rows of events."""
    return trials_of(table(spark, sf_dir, "events"))


def trials_of(e: DataFrame) -> DataFrame:
    """trials() of rows of events, a table or a stream."""
    k = F.get_json_object("props", "$.k").cast("long")
    verdict = F.when(F.col("value") < 30, "PASS").when(F.col("value") < 60, "PARTIAL").otherwise("FAIL")
    name = F.when(F.col("event_type") == "view", "Full view").otherwise(F.col("event_type"))
    codebase = F.when(F.floor(F.col("event_id") / 16) % 2 == 0, "one").otherwise("two")
    return e.select(F.col("event_type").alias("condition"), name.alias("condition_name"), codebase.alias("codebase"), F.col("user_id").alias("question"), F.pmod(k, F.lit(3)).alias("assertion"), F.col("event_id").alias("trial"), verdict.alias("verdict"), F.col("value").alias("latency"), F.when(k % 4 > 0, k % 7).alias("tools"), (F.col("user_id") + 100).alias("tokens_in"), F.length("props").cast("long").alias("tokens_out"), F.col("ts"))
