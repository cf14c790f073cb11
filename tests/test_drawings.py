import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from kelpline.functions.columns import module_id
from kelpline.operators import modules as M
from kelpline.operators import resolve as R
from kelpline.plans import drawing as W
from kelpline.plans.report import text

SVG = "{http://www.w3.org/2000/svg}"


@pytest.fixture
def graph(spark):
    cols = "ord long, id string, type string, lines int, complexity double, n_imports int, exports array<string>, methods array<string>, route string, client boolean, entry boolean"
    nodes = spark.createDataFrame([
        (1, "src/api/pay.ts", "api-route", 40, 0.9, 9, ["a"], ["GET", "POST"], "/api/<pay>", False, False), (2, "src/api/login.ts", "route", 10, 0.1, 1, [], [], "/login", True, True),
        (3, "lib/db/x.ts", "utility", 300, 0.5, 0, ["p", "q", "r", "s"], [], "", False, True), (4, "lib/db/x.test.ts", "test", 5, 0.0, 1, [], [], "", False, False), (5, "lib/db/m.prisma", "schema", 50, 0.2, 0, [], [], "", False, False),
    ], cols)
    edges = spark.createDataFrame([("src/api/pay.ts", "lib/db/x.ts", "imports", 1, 0.9), ("src/api/login.ts", "lib/db/x.ts", "imports", 2, 0.9), ("lib/db/x.test.ts", "lib/db/x.ts", "tests", 3, 0.9), ("src/api/login.ts", "lib/db/m.prisma", "imports", 4, 1.44), ("src/api/pay.ts", "src/api/login.ts", "imports", 5, 0.1)], "src string, dst string, type string, ord long, weight double")
    modules = M.modules(nodes, edges)
    boxes = R.grid(modules, 60, 30)
    placed = R.spiral(nodes.withColumn("module", module_id(F.col("id"))), boxes)
    return nodes, edges, modules, M.mean_complexity(nodes), boxes, placed


def drawn(report):
    whole = text(report)
    return whole, ET.fromstring(whole)


def test_terrain(graph):
    nodes, edges, modules, heat, boxes, placed = graph
    whole, svg = drawn(W.terrain_drawing("a&b", nodes, modules, heat, boxes, placed))
    assert svg.get("viewBox") == "0 0 800 600" and ">L1: Terrain — a&amp;b<" in whole
    # lib/db has more lines: box, rings outermost first, peak, name, then the other's.
    kinds = [(e.tag.replace(SVG, ""), e.get("class")) for e in svg][4:]
    assert kinds[:5] == [("rect", None), ("ellipse", None), ("ellipse", None), ("ellipse", None), ("text", "module-label")]
    rings = [e for e in svg.iter(f"{SVG}ellipse")]
    n = {"db": max(1, int((0.5 + 0.0 + 0.2) / 3 * 5 + 3 / 8 + 0.5)), "api": max(1, int(0.5 * 5 + 2 / 8 + 0.5))}
    assert len(rings) == n["db"] + n["api"] + 2
    first = [float(e.get("rx")) for e in rings[: n["db"]]]
    assert first == sorted(first, reverse=True) and first[0] == 60 * 0.85
    dots = [e.get("r") for e in svg.iter(f"{SVG}circle")]
    assert dots == ["7.4", "2.6", "5.0", "2.0", "3.2"]


def test_infrastructure(graph):
    nodes, edges, modules, heat, boxes, placed = graph
    whole, svg = drawn(W.infrastructure_drawing("p", nodes, edges, boxes, placed))
    roads = list(svg.iter(f"{SVG}path"))
    assert len(roads) == 1 and roads[0].get("stroke-width") == "2.5" and ">3</text>" in whole
    # The tests' link is left out, the one in a module is faint.
    assert sum(e.get("opacity") == "0.15" for e in svg.iter(f"{SVG}line")) == 1
    assert "GET,POST /api/&lt;pay&gt;" in whole and sum(e.get("height") == "5.6" for e in svg.iter(f"{SVG}rect")) == 1
    assert len(list(svg.iter(f"{SVG}marker"))) == 4


def test_labels(graph):
    nodes, edges, modules, heat, boxes, placed = graph
    whole, svg = drawn(W.labels_drawing("p", nodes, edges, modules, boxes, placed))
    said = [e.text for e in svg.iter(f"{SVG}text")]
    for one in ("◆ GET,POST /api/<pay>", "▪ /login [client]", "○ x", "→ p, q, r +1", "300L ✓", "▲ x.test", "3 files · 355 lines", "db/"):
        assert one in said, one
    assert "→ a" not in said and said.index("db/") < said.index("api/")


def test_base(graph):
    nodes, edges, modules, heat, boxes, placed = graph
    # The first test is 19.7 from what it tests, so its link isn't drawn; this one is.
    edges = edges.union(edges.sparkSession.createDataFrame([("lib/db/x.test.ts", "src/api/pay.ts", "tests", 6, 0.9)], edges.schema))
    whole, svg = drawn(W.base_drawing("p", "next", nodes, edges, modules, boxes, placed))
    links = [e for e in svg.iter(f"{SVG}line")]
    assert [(e.get("stroke-width"), e.get("stroke-dasharray")) for e in links][:2] == [("1.8", "none"), ("1.8", "none")]
    assert [(e.get("stroke-width"), e.get("stroke-dasharray")) for e in links][-1] == ("0.5", "3,3")
    assert "2.88" in {e.get("stroke-width") for e in links}
    # A diamond, a triangle and a hexagon; a page; a circle; names where the radius is over 8.
    assert [len(e.get("points").split()) for e in svg.iter(f"{SVG}polygon")] == [4, 3, 6, 4, 3]
    names = [e.text for e in svg.iter(f"{SVG}text") if e.get("class") == "node-label"]
    assert names == ["pay", "x"]


def test_spatial_text_of_a_small_graph(graph):
    nodes, edges, modules, heat, boxes, placed = graph
    got = text(W.spatial_text("p", nodes, edges, modules, heat, boxes, placed, M.coverage(nodes, edges))).split("\n")
    assert got[1] == "# Canvas: 800×600 | 5 files | 405 lines | 2 modules"
    assert got[4:6] == ["## Modules", "- db (lib/db) @(60,60) 120×140: 3 files, 355 lines [complexity: 0.23] [2 entry points]"]
    assert "## API Routes (1)" in got and any(x.startswith("- GET, POST /api/<pay> @(") and x.endswith("40L complexity:0.90 — 9 imports") for x in got)
    assert "1 test files | 1/4 testable files with direct test edges (25.0%)" in got
    assert "- api @(195,60) ···> db @(60,60): 3 edges [auth:2 data:1]" in got
    assert not any(x.startswith("## Components") for x in got)
