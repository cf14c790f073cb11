"""Reports as DataFrames of lines.

A line has a section, three sort keys, its place under an entry, and the text; entries without a
limit (routes, pages) are sorted and written by Spark like any table. text() is for a project's
report that is known to be small.

Nodes have ord, id, type, lines, complexity, n_imports, exports, methods, route, client, as far
as a section needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import grows
from ..functions.columns import flow_module_id, last_two, module_id, node_domain, short_path
from ..functions.render import capitalized, complexity_bar, described, fixed, grouped, padded, some

KEYS = ("section", "k1", "k2", "k3", "sub")
#: Texts that readers of the report look for.
MARK = "KELPLINE"
LEGEND = "LEGEND: ×N=imported by N files | ═/·=coupling strong/weak | ×A→B=A direct, B total affected | dN=cascade depth | [AMP]=amplification≥2x | TN=N test files | NL=lines of code | Nx=co-change count | linked/no-import=import connection"
USAGE = "USAGE: planning→RISK,CONVENTIONS,INFRASTRUCTURE | debugging→FLOWS,CHURN,CO-CHANGE | refactoring→RISK,CHURN,CO-CHANGE | review→CONVENTIONS,RISK,CHURN | impact-analysis→RISK,CO-CHANGE"
TITLES = {
    "risk": "─── RISK (blast radius — modifying these cascades broadly) ─",
    "churn": "─── CHURN (last 30 days, top movers) ─────────────────────",
    "conventions": "─── CONVENTIONS ─────────────────────────────────────────",
    "cochange": "─── CO-CHANGE (files that change together) ───────────────",
    "flows": "─── FLOWS ──────────────────────────────────────────────",
    "hubs": "─── FLOWS (entry hubs) ──────────────────────────────────",
    "imported": "─── MOST IMPORTED ───────────────────────────────────────",
    "infrastructure": "─── INFRASTRUCTURE ──────────────────────────────────────",
    "routes": "─── API ROUTES (%d) ─────────────────────────────────",
    "pages": "─── PAGES (%d) ──────────────────────────────────────────",
    "terrain": "─── TERRAIN ─────────────────────────────────────────────",
    "hotspots": "─── HOTSPOTS (complexity > 0.3) ─────────────────────────",
    "coverage": "─── TEST COVERAGE ───────────────────────────────────────",
}
DOMAIN_ORDER = ("payment", "auth", "data")


def lines(rows: DataFrame, line: Column, k1=None, k2=None, k3=None, sub: int = 0) -> DataFrame:
    """A line for each row; null lines are left out."""
    key = lambda k: (k if isinstance(k, Column) else F.lit(k or 0.0)).cast("double")
    third = F.lit("") if k3 is None else k3.cast("string")
    return rows.select(key(k1).alias("k1"), key(k2).alias("k2"), third.alias("k3"), F.lit(sub).alias("sub"), line.alias("line")).where("line is not null")


def section(number: int, title: str | None, parts: list[DataFrame], intro: str | None = None, counted: DataFrame | None = None, always: bool = False, end: bool = True) -> DataFrame:
    """Lines under a title, with a blank line after them; nothing without lines, unless always. counted: its rows' number goes into the title."""
    body = parts[0]
    for p in parts[1:]:
        body = body.unionByName(p)
    spark = body.sparkSession
    n = (body if counted is None else counted).agg(F.count(F.lit(1)).alias("n"))
    some_ = n if always else n.where("n > 0")
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    out = body
    edge = lambda k, sub, line: some_.select(k.alias("k1"), F.lit(0.0).alias("k2"), F.lit("").alias("k3"), F.lit(sub).alias("sub"), line.alias("line"))
    if title:
        out = out.unionByName(edge(low, 0, F.format_string(title.replace("%d", "%s"), F.col("n").cast("string")) if "%d" in title else F.lit(title)))
    if intro is not None:
        out = out.unionByName(edge(low, 1, F.lit(intro))).unionByName(edge(low, 2, F.lit("")))
    if end:
        out = out.unionByName(edge(high, 0, F.lit("")))
    return out.select(F.lit(number).alias("section"), "k1", "k2", "k3", "sub", "line")


def after_blank(whole: DataFrame) -> DataFrame:
    """A titled section with a blank line before its title."""
    blank = whole.where("k1 = double('-infinity') and sub = 0").select("section", "k1", "k2", "k3", F.lit(-1).alias("sub"), F.lit("").alias("line"))
    return whole.unionByName(blank)


def combined(sections: list[DataFrame]) -> DataFrame:
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out.orderBy(*KEYS)


def text(report: DataFrame) -> str:
    return "".join(f"{r.line}\n" for r in report.orderBy(*KEYS).collect())


def header(spark: SparkSession, name: str, framework: str, totals: DataFrame, generated: str, head: str | None = None) -> DataFrame:
    """totals: one row of files, lines. generated: an ISO time to the second."""
    first = F.concat(F.lit(f"{MARK} v3 | {name} | "), capitalized(F.lit(framework)), F.lit(" | "), F.col("files").cast("string"), F.lit(" files | "), grouped(F.col("lines")), F.lit(f" lines | generated {generated}" + (f" | git:{head}" if head else "")))
    texts = [first, F.lit(LEGEND), F.lit(USAGE), F.lit("")]
    return section(0, None, [lines(totals, x, sub=i) for i, x in enumerate(texts)], end=False)


def totals(nodes: DataFrame) -> DataFrame:
    return nodes.where("type <> 'module'").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.col("lines").cast("long")), F.lit(0)).alias("lines"))


def risk_lines(tiers: DataFrame, risk: DataFrame, nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """place, node, line, cascades, exports, more of graph.risk_tiers()' rows, of which there are few."""
    rows = tiers.join(risk.drop("amplification"), "node").join(tests.select("node", "tests"), "node", "left").join(nodes.select(F.col("id").alias("node"), "exports"), "node", "left")
    s = lambda c: F.col(c).cast("string")
    mark = F.when(F.col("amplification") >= 2, "[AMP]").otherwise("     ")
    line = F.concat_ws(" ", mark, padded(F.concat(F.lit("amp"), fixed(F.col("amplification"), 1)), 7), padded(F.concat(F.lit("×"), s("direct"), F.lit("→"), s("affected")), 9), padded(F.concat(F.lit("d"), s("max_depth")), 4), padded(F.concat(s("modules"), F.lit("mod")), 5), padded(F.concat(F.lit("T"), F.coalesce(s("tests"), F.lit("0"))), 4), F.col("node"))
    others = F.array_remove("module_names", module_id(F.col("node")))
    shown = F.filter(F.coalesce("exports", F.array().cast("array<string>")), lambda x: x != "default")
    return rows.select(
        "place",
        "tier",
        "node",
        line.alias("line"),
        F.when(F.size(others) > 0, F.concat(F.lit("  cascades to: "), some(others, 5))).alias("cascades"),
        F.when(F.size(shown) > 0, F.concat(F.lit("  exports: "), some(shown, 5))).alias("exports"),
        F.when(F.col("similar") > 0, F.concat(F.lit("  +"), s("similar"), F.lit(" similar in "), module_id(F.col("node")))).alias("more"),
    )


def risk_section(tiers: DataFrame, risk: DataFrame, nodes: DataFrame, tests: DataFrame) -> DataFrame:
    rows = risk_lines(tiers, risk, nodes, tests)
    second = rows.where("tier = 2").agg(F.min("place").alias("place")).where("place is not null")
    shown = tiers.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("tier") == 1, F.col("similar"))), F.lit(0)).alias("folded"))
    kept = risk.where("affected > 1").join(nodes.where("type = 'test'").select(F.col("id").alias("node")), "node", "left_anti").agg(F.count(F.lit(1)).alias("all"))
    left = kept.crossJoin(shown).select((F.col("all") - F.col("n") - F.col("folded")).alias("left")).where("left > 0")  # a row each
    parts = [lines(rows, F.col(c), F.col("place"), sub=i) for i, c in enumerate(("line", "cascades", "exports", "more"))]
    parts += [lines(second, F.lit(""), F.col("place"), sub=-1), lines(left, F.concat(F.lit("  +"), F.col("left").cast("string"), F.lit(" more with blast radius > 1")), F.lit(1e9))]
    return section(1, TITLES["risk"], parts)


def churn_lines(churn: DataFrame, nodes: DataFrame, top: int = 10, least: int = 3) -> DataFrame:
    """commits, path, line of the files of the graph with most commits."""
    s = lambda c: F.col(c).cast("string")
    kept = churn.where(F.col("commits") >= least).join(nodes.select(F.col("id").alias("path")), "path", "left_semi").orderBy(F.desc("commits"), "path").limit(top)
    said = F.when(F.length("last_message") > 50, F.concat(F.substring("last_message", 1, 47), F.lit("..."))).otherwise(F.col("last_message"))
    line = F.concat(padded(F.concat(s("commits"), F.lit(" commits")), 12), F.lit(" "), padded(F.concat(F.lit("+"), s("added"), F.lit(" -"), s("removed")), 12), F.lit(" "), F.col("path"), F.lit('  "'), F.coalesce(said, F.lit("")), F.lit('"'))
    return kept.select("commits", "path", line.alias("line"))


def churn_section(churn: DataFrame, nodes: DataFrame) -> DataFrame:
    return section(2, TITLES["churn"], [lines(churn_lines(churn, nodes), F.col("line"), -F.col("commits"), k3=F.col("path"))])


def _bare(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.(ts|tsx|js|jsx)\z", "")


def convention_lines(found: DataFrame, broken: DataFrame, nodes: DataFrame, top: int = 8) -> DataFrame:
    """coverage, anchor, consumer, line, exceptions of the conventions that most follow."""
    # Few of a convention's exceptions are told: only their first ones and their number leave the tasks that find them.
    first = broken.withColumn("_k", F.row_number().over(Window.partitionBy("anchor", "consumer").orderBy("id"))).where("_k <= 5")
    bad = first.groupBy("anchor", "consumer").agg(F.array_sort(F.collect_list("id")).alias("bad")).join(broken.groupBy("anchor", "consumer").agg(F.count(F.lit(1)).alias("n_bad")), ["anchor", "consumer"])
    s = lambda c: F.col(c).cast("string")
    best = found.orderBy(F.desc("coverage"), "anchor", "consumer").limit(top)
    rows = best.join(bad, ["anchor", "consumer"], "left").join(grows(nodes.select(F.col("id").alias("anchor"), "exports")), "anchor", "left")
    label = F.coalesce(F.nullif(F.array_join(F.slice(F.coalesce("exports", F.array().cast("array<string>")), 1, 3), ", "), F.lit("")), F.nullif(_bare(F.col("anchor")), F.lit("")), F.lit("?"))
    line = F.concat(padded(label, 32), F.lit(" "), padded(F.concat(s("adoption"), F.lit("/"), s("total"), F.lit(" "), F.col("consumer")), 16), F.lit(" "), F.col("anchor"))
    more = F.when(F.col("n_bad") > 5, F.concat(F.lit(", +"), (F.col("n_bad") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select("coverage", "anchor", "consumer", line.alias("line"), F.when((F.size("bad") > 0) & (F.col("coverage") >= 0.7), F.concat(F.lit("  exceptions: "), F.array_join(F.transform("bad", _bare), ", "), more)).alias("exceptions"))


def conventions_section(found: DataFrame, broken: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = convention_lines(found, broken, nodes)
    key = F.concat_ws("\t", "anchor", "consumer")
    return section(3, TITLES["conventions"], [lines(rows, F.col(c), -F.col("coverage"), k3=key, sub=i) for i, c in enumerate(("line", "exceptions"))])


def cochange_lines(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, linked, line of history.top_pairs(), which is cut before files outside the graph go."""
    ids = nodes.select("id")
    kept = pairs.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    line = F.concat(padded(F.concat(F.col("together").cast("string"), F.lit("×")), 5), F.lit(" "), last_two(F.col("a")), F.lit(" ↔ "), last_two(F.col("b")), F.lit("  ("), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("% "), F.when(F.col("linked"), "linked").otherwise("no-import"), F.lit(")"))
    return kept.select("a", "b", "linked", (F.col("confidence") * F.col("together")).alias("weight"), line.alias("line"))


def cochange_section(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return section(4, TITLES["cochange"], [lines(cochange_lines(pairs, nodes), F.col("line"), F.col("linked").cast("int"), -F.col("weight"), F.concat_ws("\t", "a", "b"))])


def outgoing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, deps: shortened paths of the files of other fine modules that a file imports, those of most complexity first."""
    links = edges.where("type <> 'tests'").where(flow_module_id(F.col("src")) != flow_module_id(F.col("dst"))).groupBy("src", "dst").agg(F.min("ord").alias("eord"))
    rows = links.join(nodes.select(F.col("id").alias("dst"), F.col("complexity").alias("c")), "dst", "left")
    return rows.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("c", F.lit(0.0))).alias("c"), "eord", "dst"))), lambda x: short_path(x["dst"])).alias("deps"))


def flow_lines(flows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, place, entry, line of modules.flows(), without the test domain."""
    rows = flows.where("domain <> 'test'").drop("deps").join(outgoing(nodes, edges).withColumnRenamed("src", "entry"), "entry")
    label = padded(F.when(F.col("place") == 1, F.concat("domain", F.lit(":"))).otherwise(""), 12)
    return rows.select("domain", "place", "entry", F.concat(label, short_path(F.col("entry")), F.lit(" -> "), F.array_join("deps", ", ")).alias("line"))


def hub_lines(risk: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """node, amplification, line: the first files by amplification that import files of other modules; for projects without routes."""
    rows = risk.where("affected > 1").join(nodes.select(F.col("id").alias("node"), "ord"), "node").join(outgoing(nodes, edges).withColumnRenamed("src", "node"), "node")
    rows = rows.orderBy(F.desc("amplification"), "ord").limit(top)
    mark = F.when(F.col("amplification") >= 2, "[AMP]").otherwise("     ")
    return rows.select("node", "amplification", "ord", F.concat(mark, F.lit(" "), short_path(F.col("node")), F.lit(" -> "), F.array_join("deps", ", ")).alias("line"))


def flows_section(flows: DataFrame, risk: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = flow_lines(flows, nodes, edges)
    domain = F.coalesce(F.array_position(F.array(*map(F.lit, DOMAIN_ORDER)), F.col("domain")).cast("int"), F.lit(0))
    one = section(5, TITLES["flows"], [lines(rows, F.col("line"), F.when(domain > 0, domain).otherwise(99), F.col("place"), F.col("domain"))], "Entry points and their cross-module dependencies")
    # Hubs stand in where there are no entries at all.
    entries = flows.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    hubs = hub_lines(risk, nodes, edges).crossJoin(entries).drop("n")
    return one.unionByName(section(5, TITLES["hubs"], [lines(hubs, F.col("line"), -F.col("amplification"), F.col("ord"))], "High-amplification hubs and their cross-module dependencies"))


def imported_section(top: DataFrame, number: int = 6) -> DataFrame:
    return section(number, TITLES["imported"], [lines(top, F.concat(F.lit("×"), F.col("importers").cast("string"), F.lit("  "), F.col("node")), -F.col("importers"), k3=F.col("node"))])


def infrastructure_lines(coupling: DataFrame, top: int = 10) -> DataFrame:
    """from_module, to_module, total, line of the module pairs with most edges."""
    per = coupling.groupBy("from_module", "to_module").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "category"))).alias("c"))
    rows = per.orderBy(F.desc("total"), "from_module", "to_module").limit(top)
    name = lambda c: F.regexp_extract(F.col(c), r"([^/]*)\z", 1)
    road = F.when(F.col("total") >= 10, "═══════").when(F.col("total") >= 5, "───────").otherwise("·······")
    kinds = F.array_join(F.transform("c", lambda x: F.concat(x["category"], F.lit(":"), (-x["k"]).cast("string"))), " ")
    line = F.concat(padded(name("from_module"), 12), F.lit(" "), road, F.lit("╢ "), padded(name("to_module"), 14), F.lit(" ×"), padded(F.col("total").cast("string"), 2, before=True), F.lit("  "), kinds)
    return rows.select("from_module", "to_module", "total", line.alias("line"))


def infrastructure_section(coupling: DataFrame, number: int = 7) -> DataFrame:
    return section(number, TITLES["infrastructure"], [lines(infrastructure_lines(coupling), F.col("line"), -F.col("total"), k3=F.concat_ws("\t", "from_module", "to_module"))], "Inter-module dependency roads", always=True)


def _route(c: str = "route") -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("id"))


def _methods(by: str) -> Column:
    return F.coalesce(F.nullif(F.array_join("methods", by), F.lit("")), F.lit("?"))


def _size() -> Column:
    return padded(F.concat(F.col("lines").cast("string"), F.lit("L")), 5, before=True)


def route_lines(nodes: DataFrame) -> DataFrame:
    """id, complexity, lines, ord, line of all API routes."""
    line = F.concat(padded(_methods(","), 7), padded(_route(), 50), F.lit(" "), _size(), F.lit(" "), fixed(F.col("complexity"), 2))
    return nodes.where("type = 'api-route'").select("id", "complexity", "lines", "ord", line.alias("line"))


def page_lines(nodes: DataFrame) -> DataFrame:
    """As route_lines(), of all pages."""
    name = F.concat(_route(), F.when(F.coalesce("client", F.lit(False)), " [client]").otherwise(""))
    return nodes.where("type = 'route'").select("id", "complexity", "lines", "ord", F.concat(padded(name, 44), F.lit(" "), _size(), F.lit(" "), fixed(F.col("complexity"), 2)).alias("line"))


def _by_complexity(rows: DataFrame) -> DataFrame:
    return lines(rows, F.col("line"), -F.col("complexity"), -F.col("lines"), F.lpad(F.col("ord").cast("string"), 20, "0"))


def routes_section(nodes: DataFrame) -> DataFrame:
    return section(8, TITLES["routes"], [_by_complexity(route_lines(nodes))])


def pages_section(nodes: DataFrame) -> DataFrame:
    return section(9, TITLES["pages"], [_by_complexity(page_lines(nodes))])


# --- the first format


def terrain_lines(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """module, lines, complexity (mean to nine decimals, so that the order of adding doesn't show), line of all modules."""
    mean = nodes.groupBy(module_id(F.col("id")).alias("module")).agg(F.round(F.avg("complexity"), 9).alias("complexity"))
    rows = modules.where("files > 0").join(mean, "module")
    name = F.regexp_extract("module", r"([^/]*)\z", 1)
    line = F.concat(complexity_bar(F.col("complexity")), F.lit("  "), padded(name, 14), F.lit(" "), fixed(F.col("complexity"), 2), F.lit(" "), padded(F.concat(F.col("files").cast("string"), F.lit(" files")), 9, before=True), F.lit(" "), padded(F.concat(grouped(F.col("lines")), F.lit("L")), 8, before=True), F.lit("  "), described(F.col("module")))
    return rows.select("module", "lines", "complexity", line.alias("line"))


def _cut(rows: DataFrame, line: Column, top: int, more: str) -> list[DataFrame]:
    """The first lines by complexity, and how many more there are."""
    first = rows.orderBy(F.desc("complexity"), "ord").limit(top)
    left = rows.agg((F.count(F.lit(1)) - top).alias("left")).where("left > 0")
    return [lines(first, line, -F.col("complexity"), F.col("ord")), lines(left, F.concat(F.lit("  ... +"), F.col("left").cast("string"), F.lit(f" more {more}")), F.lit(1e9))]


def first_format(name: str, framework: str, nodes: DataFrame, edges: DataFrame, modules: DataFrame, coupling: DataFrame, top: DataFrame, coverage: DataFrame) -> DataFrame:
    """The older report. modules, coupling, top, coverage: as operators.modules gives them, top with test edges."""
    title = F.concat(F.lit(f"{MARK} v1 | {name} | "), capitalized(F.lit(framework)), F.lit(" | "), F.col("files").cast("string"), F.lit(" files | "), grouped(F.col("lines")), F.lit(" lines"))
    t = totals(nodes)
    routes, pages = nodes.where("type = 'api-route'"), nodes.where("type = 'route'")
    note = F.when(F.col("complexity") > 0.8, " ← payment+POS hub").when(_route().contains("cancel"), " ← void flow").otherwise("")
    route = F.concat(padded(_methods(","), 18), F.lit(" "), padded(_route(), 44), F.lit(" "), _size(), F.lit("  "), fixed(F.col("complexity"), 2), note)
    note = F.when(_route() == "/", "  homepage").when(_route().contains("order/review"), "  ← payment UI").otherwise("")
    page = F.concat(padded(F.concat(_route(), F.when(F.coalesce("client", F.lit(False)), " [client]").otherwise("")), 40), F.lit(" "), _size(), F.lit("  "), fixed(F.col("complexity"), 2), note)
    hot = nodes.where("type not in ('test', 'config') and complexity > 0.3").orderBy(F.desc("complexity"), "ord").limit(10)
    suffix = F.when(F.col("type") == "api-route", F.coalesce(F.array_join("methods", ","), F.lit(""))).when((F.col("type") == "route") & F.col("client"), "[client]").otherwise("")
    hot_line = F.concat(fixed(F.col("complexity"), 2), F.lit("  "), padded(F.col("id"), 52), F.lit(" "), padded(F.col("lines").cast("string"), 4, before=True), F.lit("L "), padded(F.col("n_imports").cast("string"), 2, before=True), F.lit("imp "), suffix)
    share = F.when(F.col("testable") > 0, fixed(F.col("tested") / F.col("testable") * 100, 1)).otherwise("0")
    tested = F.concat(F.col("test_files").cast("string"), F.lit(" test files | "), F.col("tested").cast("string"), F.lit("/"), F.col("testable").cast("string"), F.lit(" testable files with direct test edges ("), share, F.lit("%)"))
    ground = terrain_lines(nodes, modules)
    return combined(
        [
            section(0, None, [lines(t, title)]),
            section(1, TITLES["terrain"], [lines(ground, F.col("line"), -F.col("lines"), k3=F.col("module"))], "Module complexity heatmap (█=high ▓=mid ░=low ·=minimal)", always=True),
            infrastructure_section(coupling, 2),
            section(3, TITLES["routes"], _cut(routes, route, 12, "routes"), counted=routes),
            section(4, TITLES["pages"], _cut(pages, page, 10, "pages"), counted=pages),
            section(5, TITLES["hotspots"], [lines(hot, hot_line, -F.col("complexity"), F.col("ord"))]),
            imported_section(top, 6),
            section(7, TITLES["coverage"], [lines(coverage, tested)], end=False),
        ]
    )


# --- the plain text


def plain_text(name: str, framework: str, nodes: DataFrame, modules: DataFrame, top: DataFrame, coverage: DataFrame, risk: DataFrame | None = None, bare: bool = False) -> DataFrame:
    """The Markdown-like report; bare leaves out what comes from analysis. modules have module, files, lines, entries."""
    s = lambda c: F.col(c).cast("string")
    t = totals(nodes)
    n_modules = modules.agg(F.count(F.lit(1)).alias("n"))
    out = [section(0, None, [lines(t, F.lit(f"# {name}")), lines(t, F.lit(f"Framework: {framework}"), sub=1), lines(t, F.concat(F.lit("Files: "), s("files"), F.lit(" | Lines: "), grouped(F.col("lines"))), sub=2), lines(n_modules, F.concat(F.lit("Modules: "), s("n")), sub=3)])]
    short = F.regexp_extract("module", r"([^/]*)\z", 1)
    line = F.concat(F.lit("- "), short, F.lit(" ("), F.col("module"), F.lit("): "), s("files"), F.lit(" files, "), s("lines"), F.lit(" lines"), F.when(F.col("entries") > 0, F.concat(F.lit(" ["), s("entries"), F.lit(" entry points]"))).otherwise(""))
    out.append(section(1, "## Modules", [lines(modules, line, -F.col("lines"), k3=F.col("module"))], always=True, end=False))

    def titled(number: int, title: str, parts: list[DataFrame], counted: DataFrame | None = None, always: bool = False) -> None:
        out.append(after_blank(section(number, title, parts, counted=counted, always=always, end=False)))

    if risk is not None and not bare:
        listed = risk.where("affected > 1").join(nodes.select(F.col("id").alias("node"), "ord"), "node")
        best = listed.orderBy(F.desc("amplification"), "ord").limit(8)
        left = listed.agg((F.count(F.lit(1)) - 8).alias("left")).where("left > 0")
        line = F.concat(F.lit("- "), F.col("node"), F.lit(": "), s("affected"), F.lit(" affected, depth "), s("max_depth"), F.lit(", "), s("modules"), F.lit(" modules, amp "), fixed(F.col("amplification"), 1))
        titled(2, "## Risk (Change With Care)", [lines(best, line, -F.col("amplification"), F.col("ord")), lines(left, F.concat(F.lit("  ... and "), s("left"), F.lit(" more with blast radius > 1")), F.lit(1e9))])
    listed = F.concat(F.lit("- "), _methods(", "), F.lit(" "), _route(), F.lit(" ("), s("lines"), F.lit(" lines)"))
    titled(3, "## API Routes (%d)", [lines(nodes.where("type = 'api-route'"), listed, F.col("ord"))])
    listed = F.concat(F.lit("- "), _route(), F.when(F.coalesce("client", F.lit(False)), " [client]").otherwise(""), F.lit(" ("), s("lines"), F.lit(" lines)"))
    titled(4, "## Pages (%d)", [lines(nodes.where("type = 'route'"), listed, F.col("ord"))])
    parts = nodes.where("type = 'component'")
    name_of = F.regexp_extract("id", r"([^/]*)\z", 1)
    if bare:  # by name, as a dictionary has it
        key = F.collate("_name", "UNICODE")
        best = parts.withColumn("_name", name_of).orderBy(key, "ord").limit(20)
        best = best.withColumn("_place", F.row_number().over(Window.orderBy(F.collate("_name", "UNICODE"), "ord")))  # of twenty rows
        shown = [lines(best, F.concat(F.lit("- "), F.col("_name"), F.lit(" ("), s("lines"), F.lit(" lines)")), F.col("_place"))]
    else:
        best = parts.orderBy(F.desc("complexity"), "ord").limit(20)
        shown = [lines(best, F.concat(F.lit("- "), name_of, F.lit(" ("), s("lines"), F.lit(" lines, complexity: "), fixed(F.col("complexity"), 2), F.lit(")")), -F.col("complexity"), F.col("ord"))]
    left = parts.agg((F.count(F.lit(1)) - 20).alias("left")).where("left > 0")
    titled(5, "## Components (%d)", [*shown, lines(left, F.concat(F.lit("  ... and "), s("left"), F.lit(" more")), F.lit(1e9))], counted=parts)
    if "models" in nodes.columns:
        models = F.coalesce("models", F.array().cast("array<string>"))
        titled(6, "## Data Schema", [lines(nodes.where("type = 'schema'"), F.concat(F.lit("- "), name_of, F.lit(": "), F.size(models).cast("string"), F.lit(" models ("), F.array_join(models, ", "), F.lit(")")), F.col("ord"))])
    if not bare:
        hot = nodes.where("type not in ('test', 'config')").orderBy(F.desc("complexity"), "ord").limit(10)
        titled(7, "## Complexity Hotspots (top 10)", [lines(hot, F.concat(F.lit("- "), F.col("id"), F.lit(" ("), s("lines"), F.lit(" lines, "), s("n_imports"), F.lit(" imports)")), -F.col("complexity"), F.col("ord"))], always=True)
        titled(8, "## Most Depended-On Files", [lines(top, F.concat(F.lit("- "), F.col("node"), F.lit(" (imported by "), s("importers"), F.lit(" files)")), -F.col("importers"), k3=F.col("node"))])
        share = F.when(F.col("testable") > 0, fixed(F.col("tested") / F.col("testable") * 100, 0)).otherwise("0")
        titled(9, "## Test Coverage", [lines(coverage, F.concat(s("test_edges"), F.lit(" test files covering "), s("tested"), F.lit("/"), s("testable"), F.lit(" files ("), share, F.lit("%)")))])
    return combined(out)


# --- reading reports again


def parsed_headers(texts: DataFrame, mark: str = MARK) -> DataFrame:
    """texts (key, text) with the header's version, project, framework, files, lines, generated, head; all null where it isn't one."""
    first = F.split(F.substring_index("text", "\n", 1), r" \| ", -1)
    part = lambda i: F.get(first, F.lit(i))
    count = lambda i, unit: F.coalesce(F.replace(F.regexp_extract(part(i), rf"^([\d,]+)\s+{unit}s?\z", 1), F.lit(","), F.lit("")).try_cast("long"), F.lit(0))
    version = F.nullif(F.regexp_extract(part(0), rf"^{mark}\s+(v\d+)\z", 1), F.lit(""))
    stamp = F.nullif(F.regexp_extract(part(5), r"^generated\s+(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\z", 1), F.lit(""))
    rows = texts.select("key", version.alias("version"), F.trim(part(1)).alias("project"), F.trim(part(2)).alias("framework"), count(3, "file").alias("files"), count(4, "line").alias("lines"), stamp.alias("generated"), F.nullif(F.regexp_extract(F.coalesce(part(6), F.lit("")), r"^git:([a-f0-9]+)\z", 1), F.lit("")).alias("head"))
    good = F.col("version").isNotNull() & F.col("generated").isNotNull()
    return rows.select("key", *[F.when(good, F.col(c)).alias(c) for c in rows.columns[1:]])


def without_sections(text: Column, names: tuple[str, ...]) -> Column:
    """A report's text without the sections of these names; runs of blank lines become one."""
    for name in names:
        quoted = "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in name)
        text = F.regexp_replace(text, rf"\A([\s\S]*?)\n─── {quoted}[^\n]*─+\n[\s\S]*?(?=\n─── |\z)", "$1")
    return F.regexp_replace(text, r"\n{3,}", "\n\n") if names else text


def variant(report: DataFrame, plain: DataFrame, bare: DataFrame, kind: str, usage: bool = True, leave_out: tuple[int, ...] = ()) -> DataFrame:
    """The lines that an experiment's condition shows: v3 (perhaps without its usage line or some sections), v2, text, text-bare or none."""
    if kind == "v3":
        return report.where(F.lit(usage) | ~F.col("line").startswith("USAGE:")).where(~F.col("section").isin(*leave_out) if leave_out else F.lit(True))
    if kind == "v2":
        return report.where(~F.col("line").startswith("USAGE:") & ~F.col("section").isin(2, 3))
    if kind in ("text", "text-bare"):
        return plain if kind == "text" else bare
    if kind == "none":
        return report.limit(0)
    raise ValueError(f"no variant {kind!r}")


def prompt(encoding: Column, question: Column, before: Column | None = None) -> Column:
    """What a model is asked: the question alone where there is no encoding."""
    whole = question if before is None else F.when(F.length(F.coalesce(before, F.lit(""))) > 0, F.concat(before, F.lit("\n\n"), question)).otherwise(question)
    return F.when(encoding == "", whole).otherwise(F.concat(F.lit("Here is an encoding of a codebase:\n\n"), encoding, F.lit("\n\nBased on this encoding, answer the following question:\n\n"), whole))
