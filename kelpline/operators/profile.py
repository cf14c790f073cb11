"""What is known of files: risk, churn, partners, tests and conventions, by left joins on the path.

Every function works on all files; the functions that end in _of are for the files that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def partners(pairs: DataFrame) -> DataFrame:
    """node, partners of both sides of co-changing pairs: structs file, together, confidence, linked, strongest first."""
    of = lambda x, y: pairs.select(F.col(x).alias("node"), F.col(y).alias("file"), "together", "confidence", "linked")
    strong = F.struct((-F.col("confidence") * F.col("together")).alias("k"), "file", "together", "confidence", "linked")
    listed = of("a", "b").unionByName(of("b", "a")).groupBy("node").agg(F.array_sort(F.collect_list(strong)).alias("p"))
    return listed.select("node", F.transform("p", lambda x: F.struct(x["file"].alias("file"), x["together"].alias("together"), x["confidence"].alias("confidence"), x["linked"].alias("linked"))).alias("partners"))


def tests_by_file(found: DataFrame) -> DataFrame:
    """graph.test_map() as a row for each file: node, direct_tests, transitive_tests (structs test, via), n_tests; direct ones by code units, the others in Unicode's order of words."""
    direct = F.col("kind") == "direct"
    # As a dictionary has them: collated keys, and then the names themselves.
    keyed = F.struct(F.collate("test", "UNICODE").alias("k"), "test", "via")
    per = found.groupBy(F.col("root").alias("node")).agg(F.array_sort(F.collect_list(F.when(direct, F.col("test")))).alias("direct_tests"), F.array_sort(F.collect_list(F.when(~direct, keyed))).alias("_t"))
    per = per.withColumn("transitive_tests", F.transform("_t", lambda t: F.struct(t["test"].alias("test"), t["via"].alias("via")))).drop("_t")
    return per.withColumn("n_tests", (F.size("direct_tests") + F.size("transitive_tests")).cast("long"))


def with_no_tests(rows: DataFrame) -> DataFrame:
    """rows of a left join with tests_by_file(): empty lists for nulls."""
    none = {"direct_tests": "array<string>", "transitive_tests": "array<struct<test: string, via: string>>"}
    return rows.withColumns({k: F.coalesce(F.col(k), F.array().cast(t)) for k, t in none.items()}).withColumn("n_tests", F.coalesce("n_tests", F.lit(0).cast("long")))


def violations(broken: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, violations: a text for each convention that the file doesn't follow."""
    exports = nodes.select(F.col("id").alias("anchor"), F.array_join(F.coalesce("exports", F.array().cast("array<string>")), ",").alias("e"))
    rows = broken.join(found, ["anchor", "consumer"]).join(exports, "anchor", "left")
    said = F.concat("anchor", F.lit(":"), F.coalesce("e", F.lit("")), F.lit(" — "), "consumer", F.lit(" ("), F.floor(F.col("coverage") * 100 + 0.5).cast("string"), F.lit("% adoption)"))
    return rows.groupBy(F.col("id").alias("node")).agg(F.array_sort(F.collect_list(said)).alias("violations"))


def risk_profile(files: DataFrame, risk: DataFrame, churn: DataFrame, pairs: DataFrame, tests: DataFrame, broken: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row for each of files (id): direct to module_names from risk, commits to last_message from churn (null where there is none), partners, tests and violations.

    tests: graph.test_map(); broken, found: modules.violators() and conventions(). Risk is told of files that more than one file depends on.
    """
    out = files.select(F.col("id").alias("node")).join(risk.where("affected > 1"), "node", "left")
    out = out.join(churn.select(F.col("path").alias("node"), "commits", "added", "removed", "last_message"), "node", "left")
    out = out.join(partners(pairs), "node", "left").join(tests_by_file(tests), "node", "left").join(violations(broken, found, nodes), "node", "left")
    empty = {"partners": "array<struct<file: string, together: bigint, confidence: double, linked: boolean>>", "direct_tests": "array<string>", "transitive_tests": "array<struct<test: string, via: string>>", "violations": "array<string>"}
    return out.withColumns({k: F.coalesce(F.col(k), F.array().cast(t)) for k, t in empty.items()}).withColumn("n_tests", F.coalesce("n_tests", F.lit(0)))


def blast_radius_of(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, direct, affected, amplification, max_depth, modules, module_names, path (of the longest cascade) for files (id); zeros where none depends on one."""
    risk = graph.blast_radius(nodes, edges, files)
    ways = graph.cascade_paths(edges, nodes, files).select(F.col("root").alias("node"), "path")
    out = files.select(F.col("id").alias("node")).join(risk.drop("weighted"), "node", "left").join(ways, "node", "left")
    none = F.array().cast("array<string>")
    return out.na.fill(0, ["direct", "affected", "amplification", "max_depth", "modules"]).withColumns({"module_names": F.coalesce("module_names", none), "path": F.coalesce("path", none)})


def as_json(rows: DataFrame) -> DataFrame:
    """One column: each row as a JSON text, nulls included."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def as_text(profiles: DataFrame) -> DataFrame:
    """node, text of risk_profile(), a few lines for each file."""
    s = lambda c: F.col(c).cast("string")
    risk = F.when(F.col("direct").isNull(), "risk: (none)").otherwise(F.concat(F.lit("risk: ×"), s("direct"), F.lit("→"), s("affected"), F.lit("  d"), s("max_depth"), F.lit("  amp"), s("amplification"), F.lit("  "), s("modules"), F.lit("mod")))
    churn = F.when(F.col("commits").isNull(), "churn: (none)").otherwise(F.concat(F.lit("churn: "), s("commits"), F.lit(" commits/30d  +"), s("added"), F.lit(" -"), s("removed"), F.lit('  last: "'), F.coalesce("last_message", F.lit("")), F.lit('"')))
    one = lambda p: F.concat(p["file"], F.lit(" ("), p["together"].cast("string"), F.lit("×, "), F.floor(p["confidence"] * 100 + 0.5).cast("string"), F.lit("% confidence"), F.when(p["linked"], ", linked").otherwise(""), F.lit(")"))
    with_ = F.concat(F.lit("co-change: "), F.when(F.size("partners") == 0, "(none)").otherwise(F.array_join(F.transform("partners", one), "; ")))
    named = F.concat(F.transform("direct_tests", lambda t: F.concat(t, F.lit(" (direct)"))), F.transform("transitive_tests", lambda t: F.concat(t["test"], F.lit(" (transitive)"))))
    tests = F.concat(F.lit("tests: "), F.when(F.col("n_tests") == 0, "(none)").otherwise(F.array_join(named, ", ")))
    rules = F.concat(F.lit("conventions: "), F.when(F.size("violations") == 0, "no violations").otherwise(F.array_join("violations", "; ")))
    return profiles.select("node", F.concat_ws("\n", "node", risk, churn, with_, tests, rules).alias("text"))


def blast_radius_text(rows: DataFrame) -> DataFrame:
    """node, text of blast_radius_of(): the numbers, the modules and the cascade, where there are any."""
    s = lambda c: F.col(c).cast("string")
    whole = F.when(F.col("amplification") == F.floor("amplification"), F.floor("amplification").cast("string")).otherwise(s("amplification"))
    first = F.concat("node", F.lit("  \u00d7"), s("direct"), F.lit("\u2192"), s("affected"), F.lit("  d"), s("max_depth"), F.lit("  amp"), whole, F.lit("  "), s("modules"), F.lit("mod"))
    modules = F.when(F.size("module_names") > 0, F.concat(F.lit("affected modules: "), F.array_join("module_names", ", ")))
    step = F.transform("path", lambda x, i: F.concat(F.element_at(F.split(x, "/"), -1), F.lit("(d"), (i + 1).cast("string"), F.lit(")")))
    return rows.select("node", F.concat_ws("\n", first, modules, F.when(F.size("path") > 0, F.concat(F.lit("cascade: "), F.array_join(step, " \u2192 ")))).alias("text"))


def test_map_text(rows: DataFrame) -> DataFrame:
    """node, text of tests_by_file(): how many tests, the direct ones, and a line for each other one."""
    first = F.concat("node", F.lit(" \u2014 "), F.col("n_tests").cast("string"), F.lit(" test files connected (structural, not runtime coverage)"))
    direct = F.when(F.size("direct_tests") > 0, F.concat(F.lit("direct: "), F.array_join("direct_tests", ", ")))
    others = F.transform("transitive_tests", lambda t: F.concat(F.lit("transitive: "), t["test"], F.lit(" (via "), t["via"], F.lit(")")))
    return rows.select("node", F.concat_ws("\n", first, direct, others).alias("text"))
