"""A code graph with places: a text with coordinates, and drawings as SVG, both as lines like those of report.py.

nodes (ord, id, type, lines, complexity, n_imports, exports, methods, route, client), edges (src,
dst, type, ord), modules (module, files, lines, entries), boxes of resolve.grid(), placed of
resolve.spiral(). Elements are sorted and written by Spark, however many files there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import edge_category, module_id
from ..functions.render import COMPLEXITY_COLOURS, TYPE_COLOURS, complexity_colour, fixed, glyph, grouped, plain_number, type_colour, xml_escaped
from ..operators import drawing as D
from ..operators import resolve as R
from .report import _methods, _route, after_blank, combined, lines, section, totals

NAME = r"([^/]*)\z"
# What the drawings say and look like.
GROUND, OUTLINE, FADED, LINK = "#F8F9FA", "#DEE2E6", "#6C757D", "#264653"
FLOW_WORDS = {"auth": "Auth flow", "payment": "Payment flow", "data": "Data flow", "rendering": "Rendering flow"}
TYPE_WORDS = {"api-route": "API Route", "route": "Page/Route", "component": "Component", "schema": "Schema", "utility": "Utility", "test": "Test"}
STYLES = {
    "base": ".module-label { font-size: 11px; font-weight: bold; fill: #333; } .node-label { font-size: 7px; fill: #555; } .layer-title { font-size: 14px; font-weight: bold; fill: #111; } .layer-subtitle { font-size: 10px; fill: #666; } .legend-text { font-size: 9px; fill: #444; }",
    "terrain": ".layer-title { font-size: 14px; font-weight: bold; fill: #111; } .layer-subtitle { font-size: 10px; fill: #666; } .module-label { font-size: 11px; font-weight: bold; fill: #333; opacity: 0.8; }",
    "infrastructure": ".layer-title { font-size: 14px; font-weight: bold; fill: #111; } .layer-subtitle { font-size: 10px; fill: #666; } .module-label { font-size: 10px; fill: #999; font-weight: bold; } .api-label { font-size: 8px; fill: #E63946; font-weight: bold; }",
    "labels": ".layer-title { font-size: 14px; font-weight: bold; fill: #111; } .layer-subtitle { font-size: 10px; fill: #666; } .module-header { font-size: 11px; font-weight: bold; fill: #111; } .module-stats { font-size: 8px; fill: #888; } .file-label { font-size: 7px; fill: #333; } .export-label { font-size: 6px; fill: #666; } .type-indicator { font-size: 6px; fill: #999; }",
}


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _whole(c: str) -> Column:
    return F.floor(F.col(c) + 0.5).cast("long").cast("string")


def _at(x: str = "x", y: str = "y") -> Column:
    return _text("@(", _whole(x), ",", _whole(y), ")")


def spatial_text(name: str, nodes: DataFrame, edges: DataFrame, modules: DataFrame, complexity: DataFrame, boxes: DataFrame, placed: DataFrame, coverage: DataFrame) -> DataFrame:
    """A Markdown-like report whose entries have places. complexity: module, complexity; coverage: a row of modules.coverage()."""
    sizes = totals(nodes).crossJoin(R.canvas(boxes)).crossJoin(modules.agg(F.count(F.lit(1)).alias("n")))  # a row each
    head = [F.lit(f"# {name} — Spatial Encoding"), _text("# Canvas: ", _whole("width"), "×", _whole("height"), " | ", _s("files"), " files | ", grouped(F.col("lines")), " lines | ", _s("n"), " modules"), F.lit("# Positions encode spatial layout — nearby coordinates = related code"), F.lit("")]
    out = [section(0, None, [lines(sizes, x, sub=i) for i, x in enumerate(head)], end=False)]

    each = boxes.join(modules, "module").join(complexity.select("module", "complexity"), "module").withColumn("_name", F.regexp_extract("module", NAME, 1))
    entries = F.when(F.col("entries") > 0, _text(" [", _s("entries"), " entry points]")).otherwise("")
    line = _text("- ", F.col("_name"), " (", F.col("module"), ") ", _at(), " ", _whole("width"), "×", _whole("height"), ": ", _s("files"), " files, ", grouped(F.col("lines")), " lines [complexity: ", fixed(F.col("complexity"), 2), "]", entries)
    out.append(section(1, "## Modules", [lines(each, line, -F.col("lines"), k3=F.col("module"))], always=True, end=False))

    files = nodes.join(placed.select("id", "x", "y"), "id", "left")
    place = F.coalesce(_text(" ", _at()), F.lit(""))
    size = _text(" ", _s("lines"), "L complexity:", fixed(F.col("complexity"), 2))
    many = F.when(F.col("n_imports") > 8, _text(" — ", _s("n_imports"), " imports")).otherwise("")
    client = F.when(F.coalesce("client", F.lit(False)), " [client]").otherwise("")
    for number, kind, title, line in ((2, "api-route", "## API Routes (%d)", _text("- ", _methods(", "), " ", _route(), place, size, many)), (3, "route", "## Pages (%d)", _text("- ", _route(), client, place, size))):
        out.append(after_blank(section(number, title, [lines(files.where(F.col("type") == kind), line, -F.col("complexity"), F.col("ord"))], end=False)))
    parts = files.where("type = 'component'")
    left = parts.agg((F.count(F.lit(1)) - 20).alias("left")).where("left > 0")
    best = parts.orderBy(F.desc("complexity"), "ord").limit(20)
    shown = [lines(best, _text("- ", F.regexp_extract("id", NAME, 1), place, size), -F.col("complexity"), F.col("ord")), lines(left, _text("  ... and ", _s("left"), " more"), F.lit(1e9))]
    out.append(after_blank(section(4, "## Components (%d)", shown, counted=parts, end=False)))

    of = lambda c, n: boxes.select(F.col("module").alias(c), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.regexp_extract("module", NAME, 1).alias(f"_{n}"))
    a, b = module_id(F.col("src")), module_id(F.col("dst"))
    per = edges.where(a != b).groupBy(a.alias("a"), b.alias("b"), edge_category(F.col("src"), F.col("dst")).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    kinds = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "c")))
    links = per.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.array_join(F.transform(kinds, lambda c: F.concat(c["c"], F.lit(":"), (-c["k"]).cast("string"))), " ").alias("kinds"))
    links = links.join(of("a", 1), "a").join(of("b", 2), "b")
    drawn = F.when(F.col("n") >= 10, "═══").when(F.col("n") >= 5, "───").otherwise("···")
    line = _text("- ", F.col("_1"), " ", _at("x1", "y1"), " ", drawn, "> ", F.col("_2"), " ", _at("x2", "y2"), ": ", _s("n"), " edges [", F.col("kinds"), "]")
    out.append(after_blank(section(5, "## Flows (inter-module edges)", [lines(links, line, -F.col("n"), F.col("first"))], always=True, end=False)))

    hot = files.where("type not in ('test', 'config')").orderBy(F.desc("complexity"), "ord").limit(10)
    line = _text("- ", F.coalesce(_text(_at(), " "), F.lit("")), F.col("id"), " — ", _s("lines"), "L, ", _s("n_imports"), " imports")
    out.append(after_blank(section(6, "## Complexity Hotspots", [lines(hot, line, -F.col("complexity"), F.col("ord"))], always=True, end=False)))
    top = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(10)
    top = top.join(placed.select("id", "x", "y"), "id", "left")
    out.append(after_blank(section(7, "## Most Depended-On", [lines(top, _text("- ", F.col("id"), place, " — imported by ", _s("n")), -F.col("n"), F.col("first"))], end=False)))
    share = F.when(F.col("testable") > 0, fixed(F.col("tested") / F.col("testable") * 100, 1)).otherwise("0")
    out.append(after_blank(section(8, "## Test Coverage", [lines(coverage, _text(_s("test_edges"), " test files | ", _s("tested"), "/", _s("testable"), " testable files with direct test edges (", share, "%)"))], end=False)))
    return combined(out)


def _drawing(name: str, layer: str, title: Column | str, subtitle: Column, boxes: DataFrame, rows: DataFrame, bodies: list[list[DataFrame]], legend: list[str], height: int, defs: str = "") -> DataFrame:
    """An SVG document: bodies are drawn one after the other, each sorted by its keys; the legend is at the upper right. rows: one row with what subtitle needs."""
    page = rows.crossJoin(R.canvas(boxes).withColumnsRenamed({"width": "_w", "height": "_h"}))  # a row each
    w, h = plain_number(F.col("_w")), plain_number(F.col("_h"))
    head = [
        _text('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ', w, " ", h, '" width="', w, '" height="', h, '">'), *([F.lit(defs)] if defs else []),
        F.lit("<style>text { font-family: monospace; } " + STYLES[layer] + "</style>"), F.lit(f'<rect width="100%" height="100%" fill="{GROUND}"/>'),
        _text('<text x="60" y="30" class="layer-title">', title, " — ", xml_escaped(F.lit(name)), "</text>"), _text('<text x="60" y="45" class="layer-subtitle">', subtitle, "</text>"),
    ]
    out = [section(0, None, [lines(page, x, sub=i) for i, x in enumerate(head)], end=False)]
    out += [section(1 + i, None, body, end=False) for i, body in enumerate(bodies)]
    tail = [_text('<g transform="translate(', plain_number(F.col("_w") - 180), ',10)">'), F.lit(f'<rect x="0" y="0" width="170" height="{height}" rx="4" fill="white" stroke="{OUTLINE}" stroke-width="1" opacity="0.9"/>'), *map(F.lit, legend), F.lit("</g>"), F.lit("</svg>")]
    out.append(section(1 + len(bodies), None, [lines(page, x, sub=i) for i, x in enumerate(tail)], end=False))
    return combined(out)


def _note(x: int, y: int, text: str, size: int = 7, fill: str = "#888", bold: bool = False) -> str:
    return f'<text x="{x}" y="{y}" font-family="monospace" font-size="{size}"{" font-weight=" + chr(34) + "bold" + chr(34) if bold else ""} fill="{fill}">{text}</text>'


def _box(fill: Column | str, stroke: Column | str, rest: str) -> Column:
    return _text('<rect x="', plain_number(F.col("x")), '" y="', plain_number(F.col("y")), '" width="', plain_number(F.col("width")), '" height="', plain_number(F.col("height")), '" rx="8" fill="', fill, '" stroke="', stroke, '" ', rest, "/>")


def _module_text(shift: int, style: str, text: Column) -> Column:
    return _text('<text x="', plain_number(F.col("x") + 8), '" y="', plain_number(F.col("y") + shift), f'" class="{style}">', text, "</text>")


def _module_name() -> Column:
    return xml_escaped(F.regexp_extract("module", NAME, 1))


def terrain_drawing(name: str, nodes: DataFrame, modules: DataFrame, complexity: DataFrame, boxes: DataFrame, placed: DataFrame) -> DataFrame:
    """Modules with their contours (operators/drawing.contours()), outermost first, then a dot for each file by its complexity."""
    rows = boxes.join(modules.select("module", "lines"), "module").join(complexity.select("module", "complexity"), "module")
    order = rows.select("module", (-F.col("lines")).alias("_k"))
    fill = complexity_colour(F.col("complexity") * 0.5)
    rings = D.contours(boxes, modules, complexity).join(order, "module")
    num = lambda c: plain_number(F.col(c))
    shape = _text('<ellipse cx="', num("cx"), '" cy="', num("cy"), '" rx="', num("rx"), '" ry="', num("ry"), '" ')
    ring = F.when(F.col("ring") == 0, _text(shape, 'fill="', F.col("colour"), '" opacity="0.3"/>')).otherwise(_text(shape, 'fill="none" stroke="', F.col("colour"), '" stroke-width="1" opacity="', fixed(F.col("opacity"), 2), '"/>'))
    # Rings are between a module's box and its name: sub is 0 for the box, 1 to 7 for rings, 8 for the name.
    drawn = rings.select(F.col("_k").cast("double").alias("k1"), F.lit(0.0).alias("k2"), F.col("module").alias("k3"), (7 - F.col("ring")).cast("int").alias("sub"), ring.alias("line"))
    body = [lines(rows, _box(fill, fill, 'opacity="0.15" stroke-width="1.5" stroke-opacity="0.4"'), -F.col("lines"), k3=F.col("module")), drawn, lines(rows, _module_text(16, "module-label", _module_name()), -F.col("lines"), k3=F.col("module"), sub=8)]
    dots = nodes.select("ord", "id", "complexity").join(placed.select("id", "x", "y"), "id")
    dot = _text('<circle cx="', fixed(F.col("x"), 1), '" cy="', fixed(F.col("y"), 1), '" r="', fixed(2 + F.col("complexity") * 6, 1), '" fill="', complexity_colour(F.col("complexity")), '" opacity="0.7"/>')
    steps = [f'<rect x="{8 + 22 * i}" y="22" width="22" height="12" fill="{c}"/>' for i, c in enumerate(COMPLEXITY_COLOURS)]
    legend = [_note(8, 14, "Complexity", 9, "#333", True), *steps, _note(8, 46, "Simple"), _note(130, 46, "Complex"), _note(8, 62, "Dense contours = high complexity"), _note(8, 72, "Sparse contours = low complexity"), _note(8, 82, "Dot size = file complexity")]
    return _drawing(name, "terrain", "L1: Terrain", F.lit("Complexity topography · Dense contours = complex areas"), boxes, totals(nodes), [body, [lines(dots, dot, F.col("ord"))]], legend, 90)


def infrastructure_drawing(name: str, nodes: DataFrame, edges: DataFrame, boxes: DataFrame, placed: DataFrame) -> DataFrame:
    """Faint boxes, links within modules, roads between them with their numbers, then routes and pages."""
    outline = [lines(boxes, _box("none", OUTLINE, 'stroke-width="1" stroke-dasharray="4,4" opacity="0.5"'), F.col("y"), F.col("x"), F.col("module")), lines(boxes, _module_text(16, "module-label", _module_name()), F.col("y"), F.col("x"), F.col("module"), 1)]
    links = D.flow_links(edges, placed)
    one = lambda c: fixed(F.col(c), 1)
    inner = _text('<line x1="', one("x1"), '" y1="', one("y1"), '" x2="', one("x2"), '" y2="', one("y2"), '" stroke="', D.flow_colour(F.col("flow")), '" stroke-width="0.5" opacity="0.15"/>')
    roads = D.road_paths(D.roads(links, boxes))
    files = nodes.join(placed.select("id", "x", "y"), "id")
    n = lambda c, d=0.0: plain_number(F.col(c) + d)
    mark = _text('<polygon points="', n("x"), ",", n("y", -6), " ", n("x", 6), ",", n("y"), " ", n("x"), ",", n("y", 6), " ", n("x", -6), ",", n("y"), f'" fill="{TYPE_COLOURS["api-route"]}" stroke="#fff" stroke-width="1" opacity="0.9"/>')
    methods = F.array_join("methods", ",")
    said = _text('<text x="', n("x"), '" y="', n("y", -9), '" text-anchor="middle" class="api-label">', xml_escaped(F.concat(F.when(methods != "", F.concat(methods, F.lit(" "))).otherwise(""), F.coalesce("route", F.regexp_extract("id", NAME, 1)))), "</text>")
    page = _text('<rect x="', n("x", -4), '" y="', n("y", -2.8), f'" width="8" height="5.6" rx="2" fill="{TYPE_COLOURS["route"]}" stroke="#fff" stroke-width="0.5" opacity="0.6"/>')
    api = files.where("type = 'api-route'")
    markers = "".join(f'<marker id="arrow-{k}" viewBox="0 0 10 7" refX="10" refY="3.5" markerWidth="8" markerHeight="6" orient="auto-start-reverse"><polygon points="0 0, 10 3.5, 0 7" fill="{c}"/></marker>' for k, c in D.FLOW_COLOURS.items())
    legend = [_note(8, 14, "Flow Types", 9, "#333", True)]
    for i, (k, word) in enumerate(FLOW_WORDS.items()):
        legend += [f'<line x1="8" y1="{30 + 16 * i}" x2="28" y2="{30 + 16 * i}" stroke="{D.FLOW_COLOURS[k]}" stroke-width="2.5"/>', _note(34, 33 + 16 * i, word, 8, "#555")]
    legend.append(_note(8, 100, "Thickness = coupling strength"))
    bodies = [
        outline, [lines(links.where("from_module = to_module"), inner, F.col("ord"))], [lines(roads, F.col("path"), F.col("first")), lines(roads, F.col("label"), F.col("first"), sub=1)],
        [lines(api, mark, F.col("ord")), lines(api, said, F.col("ord"), sub=1)], [lines(files.where("type = 'route'"), page, F.col("ord"))],
    ]
    return _drawing(name, "infrastructure", "L2: Infrastructure", F.lit("Data flow · Dependency roads · Color = flow type"), boxes, totals(nodes), bodies, legend, 110, f"<defs>{markers}</defs>")


def labels_drawing(name: str, nodes: DataFrame, edges: DataFrame, modules: DataFrame, boxes: DataFrame, placed: DataFrame) -> DataFrame:
    """Modules with their sizes, and files with glyph, name or route, first exports, lines and whether a test imports them."""
    rows = boxes.join(modules.select("module", "files", "lines"), "module")
    key = {"k1": -F.col("lines"), "k3": F.col("module")}
    heads = [lines(rows, _box("white", OUTLINE, 'stroke-width="1" opacity="0.5"'), **key), lines(rows, _module_text(14, "module-header", _text(_module_name(), "/")), **key, sub=1), lines(rows, _module_text(24, "module-stats", _text(_s("files"), " files · ", _s("lines"), " lines")), **key, sub=2)]
    tested = edges.where("type = 'tests'").select(F.col("dst").alias("id")).distinct().withColumn("_tested", F.lit(True))
    files = nodes.join(placed.select("id", "x", "y", "colour"), "id").join(tested, "id", "left")
    short = F.regexp_replace(F.regexp_extract("id", NAME, 1), r"\.(ts|tsx|js|jsx|prisma)\z", "")
    exports = F.coalesce("exports", F.array().cast("array<string>"))
    models = F.coalesce("models", F.array().cast("array<string>")) if "models" in nodes.columns else F.array().cast("array<string>")
    schema = F.when(F.size(models) > 0, _text(F.size(models).cast("string"), " models: ", F.array_join(F.slice(models, 1, 4), ", "), F.when(F.size(models) > 4, _text(" +", (F.size(models) - 4).cast("string"))).otherwise(""))).otherwise("")
    route = F.coalesce("route", F.lit(""))
    what = F.when(F.col("type") == "api-route", _text(F.array_join("methods", ","), " ", route)).when(F.col("type") == "route", _text(F.when(route == "", short).otherwise(route), F.when(F.coalesce("client", F.lit(False)), " [client]").otherwise(""))).when(F.col("type") == "schema", schema).otherwise(short)
    spot = lambda dy: _text('<text x="', fixed(F.col("x") + 5, 1), '" y="', fixed(F.col("y") + dy, 1), '" class="')
    main = _text(spot(F.lit(1)), 'file-label" fill="', F.when(F.col("type") == "api-route", TYPE_COLOURS["api-route"]).otherwise("#333"), '">', xml_escaped(_text(glyph(F.col("type")), " ", what)), "</text>")
    more = F.when(F.size(exports) > 3, _text(" +", (F.size(exports) - 3).cast("string"))).otherwise("")
    shown = F.when(~F.col("type").isin("api-route", "route") & (F.size(exports) > 0), _text(spot(F.lit(8)), 'export-label">→ ', xml_escaped(_text(F.array_join(F.slice(exports, 1, 3), ", "), more)), "</text>"))
    size = _text(spot(F.when(F.size(exports) > 0, 15).otherwise(8)), 'type-indicator">', _s("lines"), "L", F.when(F.coalesce("_tested", F.lit(False)), " ✓").otherwise(""), "</text>")
    dot = _text('<circle cx="', fixed(F.col("x"), 1), '" cy="', fixed(F.col("y"), 1), '" r="2" fill="', F.col("colour"), '" opacity="0.5"/>')
    legend = [_note(8, 14, "Node Types", 9, "#333", True)]
    glyphs = {r.k: r.g for r in nodes.sparkSession.createDataFrame([(k,) for k in TYPE_WORDS], "k string").select("k", glyph(F.col("k")).alias("g")).collect()}  # six constants
    for i, (k, word) in enumerate(TYPE_WORDS.items()):
        legend += [_note(8, 28 + 14 * i, glyphs[k], 8, TYPE_COLOURS[k]), _note(20, 28 + 14 * i, word, 8, "#555")]
    legend.append(_note(8, 118, "✓ = has test coverage"))
    sizes = totals(nodes).crossJoin(modules.agg(F.count(F.lit(1)).alias("_m")))  # a row each
    subtitle = _text(_s("files"), " files · ", grouped(F.col("lines")), " lines · ", F.col("_m").cast("string"), " modules")
    return _drawing(name, "labels", "L3: Labels", subtitle, boxes, sizes, [heads, [lines(files, x, F.col("ord"), sub=i) for i, x in enumerate((dot, main, shown, size))]], legend, 130)


def base_drawing(name: str, framework: str, nodes: DataFrame, edges: DataFrame, modules: DataFrame, boxes: DataFrame, placed: DataFrame) -> DataFrame:
    """Links of 20 or longer (edges with weight), then boxes, then a shape for each file by its type, named where it is large."""
    of = lambda c, n: placed.select(F.col("id").alias(c), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    links = edges.join(of("src", 1), "src").join(of("dst", 2), "dst").where(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) >= 20)
    p = lambda c: plain_number(F.col(c) if isinstance(c, str) else c)
    test = F.col("type") == "tests"
    link = _text('<line x1="', p("x1"), '" y1="', p("y1"), '" x2="', p("x2"), '" y2="', p("y2"), '" stroke="', F.when(test, FADED).otherwise(LINK), '" stroke-width="', p(F.when(test, 0.5).otherwise(F.greatest(F.lit(0.5), F.col("weight") * 2))), '" stroke-dasharray="', F.when(test, "3,3").otherwise("none"), '"/>')
    strokes = [lines(nodes.sparkSession.range(1), F.lit('<g opacity="0.3">'), F.lit(float("-inf"))), lines(links, link, F.col("ord")), lines(nodes.sparkSession.range(1), F.lit("</g>"), F.lit(float("inf")))]
    frames = [lines(boxes, _box(TYPE_COLOURS["module"], OUTLINE, 'stroke-width="1" opacity="0.7"'), F.col("y"), F.col("x"), F.col("module")), lines(boxes, _module_text(16, "module-label", _module_name()), F.col("y"), F.col("x"), F.col("module"), 1)]
    files = nodes.join(placed.select("id", "x", "y", "radius"), "id")
    x, y, r = F.col("x"), F.col("y"), F.col("radius")
    corners = lambda *c: F.concat_ws(" ", *[F.concat(p(a), F.lit(","), p(b)) for a, b in c])
    half = r * 0.866
    style = lambda opacity: _text('fill="', type_colour(F.col("type")), f'" stroke="#fff" stroke-width="1" opacity="{opacity}"/>')
    shape = (
        F.when(F.col("type") == "api-route", _text('<polygon points="', corners((x, y - r), (x + r, y), (x, y + r), (x - r, y)), '" ', style(0.85)))
        .when(F.col("type") == "route", _text('<rect x="', p(x - r), '" y="', p(y - r * 0.7), '" width="', p(r * 2), '" height="', p(r * 1.4), '" rx="3" ', style(0.85)))
        .when(F.col("type") == "schema", _text('<polygon points="', corners((x - r, y), (x - r / 2, y - half), (x + r / 2, y - half), (x + r, y), (x + r / 2, y + half), (x - r / 2, y + half)), '" ', style(0.85)))
        .when(F.col("type") == "test", _text('<polygon points="', corners((x, y - r), (x + r, y + r * 0.7), (x - r, y + r * 0.7)), '" ', style(0.6)))
        .otherwise(_text('<circle cx="', p(x), '" cy="', p(y), '" r="', p(r), '" ', style(0.85)))
    )
    short = F.substring(F.regexp_replace(F.regexp_extract("id", NAME, 1), r"\.(ts|tsx|js|jsx)\z", ""), 1, 12)
    label = F.when(r > 8, _text('<text x="', p(x), '" y="', p(y + r + 10), '" text-anchor="middle" class="node-label">', xml_escaped(short), "</text>"))
    legend = []
    for i, (kind, word) in enumerate((k, TYPE_WORDS[k]) for k in ("route", "api-route", "component", "schema", "utility", "test")):
        at, fill = 14 + 18 * i, f'fill="{TYPE_COLOURS[kind]}"/>'
        shapes = {"route": f'<rect x="6" y="{at - 5}" width="12" height="10" rx="2" {fill}', "api-route": f'<polygon points="12,{at - 5} 17,{at} 12,{at + 5} 7,{at}" {fill}', "test": f'<polygon points="12,{at - 5} 17,{at + 4} 7,{at + 4}" {fill}'}
        legend.append(shapes.get(kind, f'<circle cx="12" cy="{at}" r="5" {fill}') + f'<text x="24" y="{at + 4}" class="legend-text">{word}</text>')
    sizes = totals(nodes).crossJoin(modules.agg(F.count(F.lit(1)).alias("_m")))  # a row each
    subtitle = _text(_s("files"), " files · ", grouped(F.col("lines")), " lines · ", F.col("_m").cast("string"), " modules")
    return _drawing(framework, "base", xml_escaped(F.lit(name)), subtitle, boxes, sizes, [strokes, frames, [lines(files, shape, F.col("ord")), lines(files, label, F.col("ord"), sub=1)]], legend, 118)
