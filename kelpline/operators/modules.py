"""Modules, weights, complexity and coverage of a code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import grows
from ..functions.columns import edge_category, flow_category, flow_module_id, module_id, node_domain, round2


def inbound(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("importers"), F.count_if(F.col("type") == "tests").alias("tests"))


def most_imported(edges: DataFrame, nodes: DataFrame, top: int = 8, with_tests: bool = False) -> DataFrame:
    """By import edges between files that are no tests; with_tests: by all edges."""
    tests = nodes.where("type = 'test'").select("id")
    kept = edges
    if not with_tests:
        kept = edges.where("type <> 'tests'").join(tests.withColumnRenamed("id", "dst"), "dst", "left_anti").join(tests.withColumnRenamed("id", "src"), "src", "left_anti")
    return kept.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("importers")).orderBy(F.desc("importers"), "node").limit(top)


def often_imported(edges: DataFrame, nodes: DataFrame, above: int = 3) -> DataFrame:
    """node, importers of files that are no tests or configuration and have more edges to them than that."""
    kept = nodes.where("type not in ('test', 'config')").select(F.col("id").alias("node"))
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("importers")).where(F.col("importers") > above).join(kept, "node", "left_semi")


def weighted(edges: DataFrame) -> DataFrame:
    """edges with weight: the more importers a target has, the less each counts."""
    counts = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_n"))
    return edges.join(counts, "dst").withColumn("weight", round2(1 / F.log(1 + F.col("_n")))).drop("_n")


def complexity(nodes: DataFrame) -> DataFrame:
    """nodes (id, lines, n_imports) with complexity: lines and imports against their 95th percentiles."""
    p = nodes.agg(F.percentile("lines", 0.95).alias("_l"), F.percentile("n_imports", 0.95).alias("_i"))
    share = lambda x, most: F.when(F.col(most) > 0, F.least(F.col(x) / F.col(most), F.lit(1.0))).otherwise(0.0)
    both = nodes.crossJoin(F.broadcast(p))  # one row of two numbers
    return both.withColumn("complexity", round2(0.6 * share("lines", "_l") + 0.4 * share("n_imports", "_i"))).drop("_l", "_i")


def entry_points(edges: DataFrame) -> DataFrame:
    """id of the files that another module imports."""
    return edges.where(module_id(F.col("src")) != module_id(F.col("dst"))).select(F.col("dst").alias("id")).distinct()


def modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """module, files, lines, entries: entries are files that another module imports; entry_points() lists them."""
    rows = nodes.join(entry_points(edges).withColumn("_entry", F.lit(1)), "id", "left")
    return rows.groupBy(module_id(F.col("id")).alias("module")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("lines").cast("long")).alias("lines"), F.count("_entry").alias("entries"))


def mean_complexity(nodes: DataFrame) -> DataFrame:
    """module, complexity: the mean of its files'."""
    return nodes.groupBy(module_id(F.col("id")).alias("module")).agg(F.avg("complexity").alias("complexity"))


def coupling(edges: DataFrame) -> DataFrame:
    """from_module, to_module, category, n: edges between modules, tests among them."""
    pair = edges.select(module_id(F.col("src")).alias("from_module"), module_id(F.col("dst")).alias("to_module"), edge_category(F.col("src"), F.col("dst")).alias("category"))
    return pair.where("from_module <> to_module").groupBy("from_module", "to_module", "category").agg(F.count(F.lit(1)).alias("n"))


def roads(edges: DataFrame) -> DataFrame:
    """Undirected: module_a, module_b, n, and the category that most of them have (by name where even)."""
    a, b = module_id(F.col("src")), module_id(F.col("dst"))
    rows = edges.where(a != b).select(F.least(a, b).alias("module_a"), F.greatest(a, b).alias("module_b"), flow_category(F.col("src"), F.col("dst")).alias("category"))
    per = rows.groupBy("module_a", "module_b", "category").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("module_a", "module_b").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "category")).alias("c")).select("module_a", "module_b", "n", F.col("c.category").alias("category"))


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: test_files, test_edges, tested (distinct targets of test edges), testable (no tests, no config)."""
    n = nodes.agg(F.count_if(F.col("type") == "test").alias("test_files"), F.count_if(~F.col("type").isin("test", "config")).alias("testable"))
    e = edges.where("type = 'tests'").agg(F.count(F.lit(1)).alias("test_edges"), F.countDistinct("dst").alias("tested"))
    return n.crossJoin(e)  # a row each


def flows(nodes: DataFrame, edges: DataFrame, per_domain: int = 3) -> DataFrame:
    """The top api-route entries of each domain: domain, place, entry, deps (count of files of other fine modules that they import)."""
    links = edges.where("type <> 'tests'").where(flow_module_id(F.col("src")) != flow_module_id(F.col("dst"))).groupBy("src", "dst").agg(F.min("ord").alias("eord"))
    entry = nodes.where("type = 'api-route'").select(F.col("id").alias("src"), F.col("complexity").alias("rank1"), F.col("lines").alias("rank2"), F.col("ord").alias("rank3"))
    rows = links.join(entry, "src").join(nodes.select(F.col("id").alias("dst"), F.col("complexity").alias("c")), "dst")
    vote = node_domain(F.col("dst"))
    rows = rows.withColumn("vote", F.when(~vote.isin("other", "test"), vote))
    one = F.min(F.when(F.col("vote").isNotNull(), F.struct((-F.col("c")).alias("c"), "eord"))).alias("first")
    votes = rows.groupBy("src", "vote").agg(F.count(F.lit(1)).alias("n"), one)
    best = votes.groupBy("src").agg(F.sum("n").alias("deps"), F.min(F.when(F.col("vote").isNotNull(), F.struct((-F.col("n")).alias("n"), "first", "vote"))).alias("b"))
    own = node_domain(F.col("src"))
    out = best.join(entry, "src").withColumn("domain", F.when(~own.isin("other", "test"), own).otherwise(F.coalesce("b.vote", F.lit("data"))))
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("rank1"), F.desc("rank2"), "rank3"))
    return out.withColumn("place", place).where(F.col("place") <= per_domain).select("domain", F.col("place").cast("long").alias("place"), F.col("src").alias("entry"), "deps")


def conventions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per anchor and consumer type with 60 % adoption or more: adoption, total, coverage."""
    of = nodes.where(~F.col("type").isin("test", "config", "schema")).select("id", "type")
    totals = of.groupBy("type").agg(F.count(F.lit(1)).alias("total")).where("total >= 3")
    # Dealt by file once: what repeats goes where files are joined.
    links = edges.where("type <> 'tests'").select(F.col("src").alias("id"), F.col("dst").alias("anchor")).repartition("id").distinct()
    counts = of.join(grows(links), "id").groupBy("type", "anchor").agg(F.count(F.lit(1)).alias("adoption"))
    kinds = nodes.select(F.col("id").alias("anchor"), F.col("type").alias("anchor_type"))
    rows = counts.join(totals, "type").withColumn("coverage", F.col("adoption") / F.col("total")).where("coverage >= 0.6")
    return rows.join(grows(kinds), "anchor", "left").where("anchor_type is null or anchor_type <> type").select("anchor", F.col("type").alias("consumer"), "adoption", "total", "coverage")


def violators(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """anchor, consumer, id of files that don't follow a convention of 70 % adoption or more."""
    strong = found.where("coverage >= 0.7").select("anchor", F.col("consumer").alias("type"))
    # A type has as many of these as a file of it has imports in the mean, over 0.7, at most.
    due = nodes.select("id", "type").join(F.broadcast(strong), "type")
    links = edges.where("type <> 'tests'").select(F.col("src").alias("id"), F.col("dst").alias("anchor")).distinct()
    return due.join(grows(links), ["id", "anchor"], "left_anti").select("anchor", F.col("type").alias("consumer"), "id")
