"""Reach over the import graph: change impact, cascade paths, tests that cover a file.

Breadth-first search runs for all roots at once, a level at a time: a join of the frontier with
the edges, less what is seen. Each level is kept in the shared folder. Where only depths are asked
for, 64 roots go together: a row is a node and a word of 64 roots, its bits tell which of them
reach the node at this level, and words that meet are merged by or. Where ways are asked for too, a
row is a root and a node, by their numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import grows, kept, shared_dir
from ..functions.columns import module_id, round2

WEAKENING = 0.7


def reverse_links(edges: DataFrame, tests: DataFrame | None = None, with_tests: bool = False) -> DataFrame:
    """node, next, ord: who imports a node; without test edges, and without sources among tests (id)."""
    kept = edges if with_tests else edges.where("type <> 'tests'")
    if tests is not None:
        kept = kept.join(grows(tests.select(F.col("id").alias("src"))), "src", "left_anti")
    return kept.groupBy(F.col("dst").alias("node"), F.col("src").alias("next")).agg(F.min("ord").alias("ord"))


def forward_links(edges: DataFrame, with_tests: bool = False) -> DataFrame:
    """node, next, ord: what a node imports."""
    kept = edges if with_tests else edges.where("type <> 'tests'")
    return kept.groupBy(F.col("src").alias("node"), F.col("dst").alias("next")).agg(F.min("ord").alias("ord"))


def numbered_roots(roots: DataFrame) -> DataFrame:
    """root, word, bit: 64 roots (id, distinct) that follow each other by name share a word, as their ways are likely to."""
    n = roots.select(F.col("id").alias("root")).repartitionByRange("root").sortWithinPartitions("root").withColumn("_n", F.monotonically_increasing_id())
    return kept(n.select("root", F.shiftright("_n", 6).alias("word"), F.col("_n").bitwiseAND(63).cast("int").alias("bit")))


def reach_words(links: DataFrame, numbers: DataFrame) -> DataFrame:
    """word, node, depth, bits: which roots of a word (numbered_roots()) reach a node first at a depth of 1 or more.

    A level is one join and one grouping: what the frontier finds and what was seen before meet by
    node and word, so that a node's many ways are merged in the tasks that find them.
    """
    links = links.select("node", "next")
    spark, folder = links.sparkSession, f"{shared_dir(links.sparkSession)}/reach-{uuid.uuid4().hex}"
    bit = F.expr("shiftleft(1L, bit)")
    level = kept(numbers.groupBy("word", F.col("root").alias("node")).agg(F.lit(0).alias("depth"), F.bit_or(bit).alias("bits")), f"{folder}/0")
    schema, paths, none = level.schema, [f"{folder}/0"], F.lit(0).cast("long")
    while not level.isEmpty():
        found = level.join(grows(links), "node").select("word", F.col("next").alias("node"), "bits", none.alias("seen"))
        seen = spark.read.schema(schema).parquet(*paths).select("word", "node", none.alias("bits"), F.col("bits").alias("seen"))
        both = found.union(seen).groupBy("word", "node").agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"))
        fresh = both.select("word", "node", F.lit(len(paths)).alias("depth"), F.col("bits").bitwiseAND(F.bitwise_not("seen")).alias("bits")).where("bits <> 0")
        paths.append(f"{folder}/{len(paths)}")
        level = kept(fresh, paths[-1])
    return spark.read.schema(schema).parquet(*paths).where("depth > 0")


def each_root(words: DataFrame) -> DataFrame:
    """A row for each bit that is set in words' bits."""
    return words.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.expr("shiftright(bits, bit) & 1 = 1")).drop("bits")


def _ways(links: DataFrame, roots: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels of reach() with parents, the roots' own first, and names (id, n): nodes go by numbers that rise as their ids do.

    What a level finds and what was seen before meet by root, where they are also ranked: a level
    is a join by node and one exchange by root, of numbers alone.
    """
    ids = links.select(F.col("node").alias("id")).union(links.select("next")).union(roots.select("id")).distinct()
    names = kept(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id()))
    of = lambda c: names.select(F.col("id").alias(c), F.col("n").alias(f"_{c}"))
    links = kept(links.join(of("node"), "node").join(of("next"), "next").select(F.col("_node").alias("node"), F.col("_next").alias("next"), "ord"))
    # Levels are folders of one table: what is seen so far is read at once.
    spark = links.sparkSession
    folder = f"{shared_dir(spark)}/reach-{uuid.uuid4().hex}"
    none = F.lit(None).cast("long")
    level = roots.join(names, "id").select(F.col("n").alias("root"), F.col("n").alias("node"), F.lit(0).alias("depth"), none.alias("parent"), F.lit(0).cast("long").alias("rank"))
    levels, paths = [kept(level, f"{folder}/0")], [f"{folder}/0"]
    schema = levels[0].schema
    way = F.struct("rank", "ord", F.col("node").alias("parent"))
    while not levels[-1].isEmpty():
        found = levels[-1].join(links, "node").select("root", F.col("next").alias("node"), way.alias("way"))
        seen = spark.read.schema(schema).parquet(*paths).select("root", "node", F.lit(None).cast(found.schema["way"].dataType).alias("way"))
        both = found.union(seen).repartition("root").groupBy("root", "node").agg(F.min("way").alias("way"), F.count_if(F.col("way").isNull()).alias("_seen")).where("_seen = 0")
        order = Window.partitionBy("root").orderBy("way.rank", "way.ord", "node")
        fresh = both.select("root", "node", F.lit(len(paths)).alias("depth"), "way.parent", F.row_number().over(order).cast("long").alias("rank"))
        paths.append(f"{folder}/{len(paths)}")
        levels.append(kept(fresh, paths[-1]))
    return levels, names


def _together(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out


def _named(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """rows with ids for the numbers in columns; the number of no node is null."""
    for c in columns:
        rows = rows.join(names.select(F.col("n").alias(c), F.col("id").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return rows


def reach(links: DataFrame, roots: DataFrame, parents: bool = False) -> DataFrame:
    """root, node, depth of all nodes reached from roots (id, distinct); a root isn't reached from itself.

    With parents also parent and rank: the first way that a queue would find, by the parent's
    rank and the link's ord. Each level is written once and stays as it is.
    """
    if not parents:
        numbers = numbered_roots(roots)
        return each_root(reach_words(kept(links), numbers)).join(numbers, ["word", "bit"]).select("root", "node", "depth")
    levels, names = _ways(links, roots)
    return _named(_together(levels).where("depth > 0"), names, "root", "node", "parent").select("root", "node", "depth", "parent", "rank")


def blast_radius(nodes: DataFrame, edges: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Per node that others import (of only's ids, where given): node, direct, affected, weighted, modules, module_names, max_depth, amplification.

    Weights are summed to nine decimals before they are cut to two, so that the order of adding doesn't show.
    """
    links = kept(reverse_links(edges, nodes.where("type = 'test'")))
    direct = links.groupBy("node").agg(F.countDistinct("next").alias("direct"))
    if only is not None:
        direct = direct.join(only.select(F.col("id").alias("node")), "node", "left_semi")
    numbers = numbered_roots(direct.select(F.col("node").alias("id")))
    got = each_root(reach_words(links, numbers).withColumn("module", module_id(F.col("node"))))
    # Sums by depth and module first, so that a root with everything below it is no large group.
    part = got.groupBy("word", "bit", "depth", "module").agg(F.count(F.lit(1)).alias("n")).join(grows(numbers), ["word", "bit"])
    per = part.groupBy("root").agg(
        F.sum("n").alias("affected"),
        round2(F.round(F.sum(F.col("n") * F.pow(F.lit(WEAKENING), F.col("depth"))), 9)).alias("weighted"),
        F.countDistinct("module").alias("modules"),
        F.array_sort(F.collect_set("module")).alias("module_names"),
        F.max("depth").cast("long").alias("max_depth"),
    )
    out = direct.join(grows(per.withColumnRenamed("root", "node")), "node", "left").na.fill(0, ["affected", "weighted", "modules", "max_depth"])
    empty = F.array().cast("array<string>")
    return out.withColumn("module_names", F.coalesce("module_names", empty)).withColumn("amplification", round2(F.col("affected") / F.col("direct")))


def cascade_paths(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Per root: max_depth and path, the way to the first node found at the greatest depth.

    The way is walked back from that node for all roots at once, so that each level is read once.
    """
    levels, names = _ways(reverse_links(edges, nodes.where("type = 'test'")), roots)
    best = _together(levels).where("depth > 0").groupBy("root").agg(F.max(F.struct("depth", (-F.col("rank")).alias("r"), "node")).alias("b"))
    at = kept(best.select("root", F.col("b.depth").alias("max_depth"), F.col("b.depth").alias("depth"), F.col("b.node").alias("node")))
    steps = [at]
    for level in reversed(levels[2:]):
        # Ways that begin at this level or above it go one up.
        back = level.select("root", "node", (F.col("depth") - 1).alias("_depth"), "parent")
        at = kept(at.join(back, ["root", "node"], "left").select("root", "max_depth", F.coalesce("_depth", "depth").alias("depth"), F.coalesce("parent", "node").alias("node")))
        steps.append(at.where(F.col("depth") < F.col("max_depth")))
    told = _named(_together(steps).distinct(), names, "node").groupBy("root", "max_depth").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("p"))
    return _named(told, names, "root").select("root", F.col("max_depth").cast("long").alias("max_depth"), F.transform("p", lambda x: x["node"]).alias("path"))


def test_map(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """root, test, kind (direct or transitive), via (the node between, for transitive ones)."""
    levels, names = _ways(reverse_links(edges, with_tests=True), roots)
    tests = names.join(nodes.where("type = 'test'").select("id"), "id", "left_semi").select(F.col("n").alias("node"))
    direct = F.col("depth") == 1
    got = _together(levels).where("depth > 0").join(tests, "node", "left_semi")
    got = got.select("root", F.col("node").alias("test"), F.when(direct, "direct").otherwise("transitive").alias("kind"), F.when(~direct, F.col("parent")).alias("via"))
    return _named(got, names, "root", "test", "via").select("root", "test", "kind", "via")


def risk_tiers(risk: DataFrame, nodes: DataFrame, first: int = 5, second: int = 3) -> DataFrame:
    """The report's rows of risk: tier, place, node, similar; one for each module, the first modules in tier 1, the next in tier 2."""
    rows = risk.where("affected > 1").join(nodes.where("type = 'test'").select(F.col("id").alias("node")), "node", "left_anti")
    rows = rows.join(nodes.select(F.col("id").alias("node"), "ord"), "node").withColumn("module", module_id(F.col("node")))
    # One row per module by partial aggregation, then a top-k: no window over all rows.
    top = rows.groupBy("module").agg(F.max(F.struct("amplification", (-F.col("ord")).alias("o"), "node")).alias("best"), F.count(F.lit(1)).alias("n"))
    top = top.orderBy(F.desc("best.amplification"), F.desc("best.o")).limit(first + second)
    place = F.row_number().over(Window.orderBy(F.desc("best.amplification"), F.desc("best.o")))
    tier = F.when(F.col("place") <= first, 1).otherwise(2)
    return top.withColumn("place", place).select(tier.cast("long").alias("tier"), F.col("place").cast("long").alias("place"), F.col("best.node").alias("node"), F.col("best.amplification").alias("amplification"), F.when(F.col("place") <= first, F.col("n") - 1).otherwise(0).alias("similar"))
