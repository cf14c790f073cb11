import duckdb
import numpy as np
from pyspark.sql import functions as F

from kelpline.operators import graph as G
from kelpline.operators import modules as M
from kelpline.operators import profile as V
from kelpline.plans import report
from kelpline.sources import star

NODES = "id string, type string, lines int, ord long"


def fixture(spark):
    """app and job stand on mail and pdf, which stand on core; mail and pdf import each other; one test tests app, another tests that test, a third core."""
    names = ["base/core.ts", "send/mail.ts", "send/pdf.ts", "main/web/app.ts", "main/job.ts", "main/web/app.spec.ts", "checks/app.spec.spec.ts", "base/core.spec.ts"]
    nodes = spark.createDataFrame([(n, "test" if ".spec." in n else "utility", 7 * i + 3, i) for i, n in enumerate(names)], NODES)
    links = [(1, 0, "imports"), (2, 0, "imports"), (2, 1, "imports"), (1, 2, "imports"), (3, 1, "imports"), (4, 2, "imports"), (4, 1, "imports"), (5, 3, "tests"), (6, 5, "tests"), (7, 0, "tests")]
    edges = spark.createDataFrame([(names[a], names[b], t, i) for i, (a, b, t) in enumerate(links)], "src string, dst string, type string, ord long")
    return nodes, edges, names


def links(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "node string, next string, ord long")


def test_blast_radius(spark):
    nodes, edges, n = fixture(spark)
    got = {x.node: x for x in G.blast_radius(nodes, edges).collect()}
    r = got[n[0]]
    # mail and pdf at depth 1, app and job at 2: 2 * 0.7 + 2 * 0.49.
    assert (r.direct, r.affected, r.weighted, r.modules, r.max_depth, r.amplification) == (2, 4, 2.38, 3, 2, 2.0)
    assert r.module_names == ["main", "main/web", "send"]
    # In a cycle a file isn't below itself.
    assert (got[n[1]].direct, got[n[1]].affected) == (3, 3) and (got[n[2]].direct, got[n[2]].affected) == (2, 3)
    one = V.blast_radius_of(spark.createDataFrame([(n[0],), (n[4],)], "id string"), nodes, edges)
    assert {(x.node, x.affected, tuple(x.path)) for x in one.collect()} == {(n[0], 4, (n[1], n[3])), (n[4], 0, ())}


def test_cascade_and_test_map(spark):
    nodes, edges, n = fixture(spark)
    roots = spark.createDataFrame([(n[0],), (n[3],)], "id string")
    got = {r.root: r for r in G.cascade_paths(edges, nodes, roots).collect()}
    assert got[n[0]].path == [n[1], n[3]] and n[3] not in got
    rows = {(r.root, r.test, r.kind, r.via) for r in G.test_map(edges, nodes, roots).collect()}
    assert rows == {(n[0], n[7], "direct", None), (n[0], n[5], "transitive", n[3]), (n[0], n[6], "transitive", n[5]), (n[3], n[5], "direct", None), (n[3], n[6], "transitive", n[5])}
    deps = {(r.node, r.next) for r in G.forward_links(edges).collect()}
    assert (n[4], n[2]) in deps and not any(a == n[5] for a, _ in deps)


def test_profile(spark):
    nodes, edges, n = fixture(spark)
    nodes = nodes.withColumn("exports", F.array(F.lit("run")))
    risk = G.blast_radius(nodes, edges)
    churn = spark.createDataFrame([(n[0], 4, 9, 2, "tidy")], "path string, commits long, added long, removed long, last_message string")
    pairs = spark.createDataFrame([(n[0], n[4], 3, 0.5, False)], "a string, b string, together long, confidence double, linked boolean")
    found = spark.createDataFrame([(n[0], "utility", 3, 4, 0.75)], "anchor string, consumer string, adoption long, total long, coverage double")
    broken = spark.createDataFrame([(n[0], "utility", n[4])], "anchor string, consumer string, id string")
    tests = G.test_map(edges, nodes, nodes)
    rows = V.risk_profile(nodes, risk, churn, pairs, tests, broken, found, nodes)
    got = {r.node: r for r in rows.collect()}
    assert len(got) == 8 and (got[n[0]].affected, got[n[0]].commits, got[n[0]].n_tests) == (4, 4, 3)
    assert got[n[4]].direct is None and got[n[4]].commits is None and got[n[4]].partners[0].file == n[0]
    assert got[n[4]].violations == ["base/core.ts:run — utility (75% adoption)"]
    text = {r.node: r.text for r in V.as_text(rows).collect()}
    assert text[n[0]].split("\n")[1:3] == ["risk: ×2→4  d2  amp2.0  3mod", 'churn: 4 commits/30d  +9 -2  last: "tidy"']
    assert "co-change: base/core.ts (3×, 50% confidence)" in text[n[4]] and "risk: (none)" in text[n[4]]
    assert '"commits":null' in [r.json for r in V.as_json(rows).collect() if f'"node":"{n[4]}"' in r.json][0]


def test_reach_cycle_diamond_and_empty(spark):
    root = spark.createDataFrame([("A",)], "id string")
    cycle = G.reach(links(spark, [("A", "B"), ("B", "A")]), root).collect()
    assert [(r.node, r.depth) for r in cycle] == [("B", 1)]
    diamond = G.reach(links(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]), root, parents=True).collect()
    assert {(r.node, r.depth, r.parent) for r in diamond} == {("B", 1, "A"), ("C", 1, "A"), ("D", 2, "B")}
    assert not G.reach(links(spark, [("A", "B")]).limit(0), root).collect()


def test_tiers_weights_modules(spark):
    nodes, edges, n = fixture(spark)
    tiers = G.risk_tiers(G.blast_radius(nodes, edges), nodes).collect()
    assert [(r.place, r.node, r.similar) for r in tiers] == [(1, n[0], 0), (2, n[2], 1)]
    w = {(r.src, r.dst): r.weight for r in M.weighted(edges).collect()}
    assert w[(n[5], n[3])] == 1.44 and w[(n[1], n[0])] == 0.72  # one edge and three: 1 / ln 2 and 1 / ln 4
    m = {r.module: r for r in M.modules(nodes, edges).collect()}
    assert m["send"].files == 2 and m["send"].entries == 2 and m["base"].entries == 1 and m["main"].entries == 0
    assert [r.node for r in M.often_imported(edges, nodes, 2).orderBy("node").collect()] == [n[0], n[1]]


def test_complexity_against_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [(f"f{i}", int(rng.lognormal(4, 1.3)), int(rng.integers(0, 12))) for i in range(137)]
    got = {r.id: r.complexity for r in M.complexity(spark.createDataFrame(rows, "id string, lines int, n_imports long")).collect()}
    most = [np.percentile([r[k] for r in rows], 95) for k in (1, 2)]
    for name, lines, imports in rows:
        assert abs(got[name] - (0.6 * min(lines / most[0], 1) + 0.4 * min(imports / most[1], 1))) <= 0.005 + 1e-9


def test_conventions(spark):
    nodes = spark.createDataFrame([(x, "api-route", 1, i) for i, x in enumerate("abcd")] + [("lib", "utility", 1, 9)], NODES)
    edges = spark.createDataFrame([(x, "lib", "imports", i) for i, x in enumerate("abc")] * 2, "src string, dst string, type string, ord long")
    found = M.conventions(nodes, edges)
    assert [(r.anchor, r.consumer, r.adoption, r.total, r.coverage) for r in found.collect()] == [("lib", "api-route", 3, 4, 0.75)]
    assert [r.id for r in M.violators(nodes, edges, found).collect()] == ["d"]
    five = nodes.union(spark.createDataFrame([("e", "api-route", 1, 8)], NODES))
    weak = M.conventions(five, edges)
    assert weak.count() == 1 and M.violators(five, edges, weak).count() == 0


def test_snapshot_point_of_a_file_that_tests_alone_import(spark, tmp_path):
    from kelpline.queries import QUERIES, SQL
    from kelpline import queries_more  # noqa: F401  registers it

    def answers(folder, lines):
        parts = [(0, "hot bolt", "Brand#1", "STANDARD", 900.0), (1, "big gear", "Brand#2", "SMALL", 901.0), (2, "old ring", "Brand#2", "ECONOMY", 902.0)]
        spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double").coalesce(1).write.parquet(f"{folder}/part.parquet")
        spark.createDataFrame(lines, "l_orderkey long, l_partkey long").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
        db = duckdb.connect()
        for t in ("part", "lineitem"):
            db.execute(f"create view {t} as from '{folder}/{t}.parquet/*.parquet'")
        return [tuple(r) for r in QUERIES["snapshot_point"](spark, folder).collect()], db.execute(SQL["snapshot_point"]).fetchall()

    got, sql = answers(str(tmp_path / "a"), [(1, 0), (1, 1)])  # a test imports part 0, and nothing else does
    assert got == sql == []
    got, sql = answers(str(tmp_path / "b"), [(1, 0), (1, 2)])
    assert got == sql and len(got) == 1


def test_joins_of_growing_tables_send_nothing_through_the_driver(spark):
    joined = lambda df: df._jdf.queryExecution().executedPlan().toString()
    folder = "/root/testdata/sf0.001"
    nodes = star.parts(spark, folder)
    assert "BroadcastHashJoin" not in joined(star.edges(spark, folder, nodes)) + joined(star.own_commits(spark, folder, nodes))
    # Seven files don't follow a convention: five are told, by name, and the number of the others.
    found = spark.createDataFrame([("s/x.ts", "route", 16, 23, 16 / 23)], "anchor string, consumer string, adoption long, total long, coverage double").withColumn("coverage", F.lit(0.7))
    broken = spark.createDataFrame([("s/x.ts", "route", f"p/{c}.ts") for c in "gfedcba"], "anchor string, consumer string, id string")
    names = spark.createDataFrame([("s/x.ts", ["guard"])], "id string, exports array<string>")
    got = report.convention_lines(found, broken, names)
    assert got.first().exceptions == "  exceptions: a, b, c, d, e, +2 more"
    assert "WindowGroupLimit" in joined(got)


def test_the_text_with_coordinates_derives_its_graph_once(spark, monkeypatch):
    from kelpline import queries_drawing  # noqa: F401  registers it
    from kelpline.queries import QUERIES

    made, edges = [], star.edges
    monkeypatch.setattr(star, "edges", lambda *x: made.append(1) or edges(*x))
    assert QUERIES["spatial_text"](spark, "/root/testdata/sf0.001").count() > 0 and made == [1]
