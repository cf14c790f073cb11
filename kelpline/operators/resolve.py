"""Which file a specifier means: by candidates, by the longest package prefix, by aliases, by a unique suffix."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import row_numbers, settled, spread, tasks_for
from ..functions.columns import folder, joined_path
from ..functions.render import complexity_colour, type_colour

# What is tried after a path, in order.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def find_nodes(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """wanted (key, path) with node: the first of the path's candidates that is a node's id, else null; one row per key."""
    tried = wanted.select("key", F.posexplode(F.array(*[F.concat("path", F.lit(e)) for e in ENDINGS])).alias("pos", "id"))
    hit = tried.join(nodes.select("id"), "id").groupBy("key").agg(F.min_by("id", "pos").alias("node"))
    return wanted.join(hit, "key", "left")


def by_alias(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted (key, spec) with path: of the aliases (alias, target, ord; a handful, from one file) the first that the specifier starts with is replaced."""
    few = aliases.select(F.col("ord").alias("_ord"), "alias", "target")
    hits = wanted.select("key", "spec").join(few, F.col("spec").startswith(F.col("alias"))).groupBy("key").agg(F.min(F.struct("_ord", "alias", "target")).alias("a"))
    return wanted.join(hits, "key", "left").withColumn("path", F.when(F.col("a").isNotNull(), F.concat("a.target", F.expr("substring(spec, length(a.alias) + 1)")))).drop("a")


def by_package(wanted: DataFrame, packages: DataFrame) -> DataFrame:
    """wanted (key, spec) with package, rest: the longest package name that is the specifier or a prefix of it before a slash.

    All prefixes are joined by equality, which needs no nested loop.
    """
    parts = F.split("spec", "/", -1)
    prefixes = wanted.select("key", "spec", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))).alias("name"))
    tasks = tasks_for(wanted.sparkSession, wanted.count())
    best = spread(prefixes.join(packages.select("name", "dir"), "name"), tasks, "key").groupBy("key").agg(F.max(F.struct(F.length("name").alias("n"), "name", "dir")).alias("b"))
    out = wanted.join(best, "key", "left")
    return out.select("key", "spec", F.col("b.name").alias("package"), F.col("b.dir").alias("dir"), F.expr("substring(spec, b.n + 2)").alias("rest"))


def imports_to_edges(nodes: DataFrame, aliases: DataFrame, packages: DataFrame) -> DataFrame:
    """nodes (ord, id, type, imports) to edges src, dst, type, ord (a struct: the file's, then the import's place); an import that is there twice gives two edges.

    Relative specifiers are joined to their file's folder; others go through aliases, those that begin with @/ or ~/ stand as they are without one; the rest is looked for among packages.
    """
    rows = nodes.select("ord", F.col("id").alias("src"), F.col("type").alias("_t"), F.posexplode("imports").alias("pos", "spec")).withColumn("key", F.struct("ord", "pos"))
    rows = by_alias(settled(rows), aliases)
    path = F.when(F.col("spec").startswith("."), joined_path(folder(F.col("src")), F.col("spec"))).otherwise(F.coalesce("path", F.when(F.col("spec").rlike("^[@~]/"), F.col("spec"))))
    rows = rows.withColumn("path", path)
    known = find_nodes(rows.where("path is not null").select("key", "path"), nodes).select("key", F.col("node").alias("dst"))
    packed = by_package(rows.where("path is null").select("key", "spec"), packages.select("name", "dir")).where("package is not null")
    packed = packed.join(packages.select(F.col("name").alias("package"), "entry"), "package")
    whole = F.col("rest") == ""
    first = packed.select("key", F.when(whole, F.concat_ws("/", "dir", F.coalesce("entry", F.lit("src/index")))).otherwise(F.concat_ws("/", "dir", "rest")).alias("path"))
    second = packed.select("key", F.when(whole, F.concat_ws("/", "dir", F.lit("index"))).otherwise(F.concat_ws("/", "dir", F.lit("src"), "rest")).alias("path"))
    two = find_nodes(first, nodes).select("key", F.col("node").alias("n1")).join(find_nodes(second, nodes).select("key", F.col("node").alias("n2")), "key")
    found = known.where("dst is not null").unionByName(two.select("key", F.coalesce("n1", "n2").alias("dst")).where("dst is not null"))
    return rows.join(found, "key").select("src", "dst", F.when(F.col("_t") == "test", "tests").otherwise("imports").alias("type"), F.col("key").alias("ord"))


def by_suffix(wanted: DataFrame, ids: DataFrame) -> DataFrame:
    """wanted (input) with id: the id itself, else the only one that ends with /input; status exact, suffix, ambiguous or unknown.

    All suffixes of the ids at slashes are joined by equality.
    """
    clean = F.regexp_replace(F.replace("input", F.lit("\\"), F.lit("/")), "^/", "")
    asked = wanted.withColumn("suffix", clean)
    parts = F.split("id", "/", -1)
    ends = ids.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, -n, n)))).alias("suffix"))
    exact = F.col("id") == F.col("suffix")
    hits = asked.join(ends, "suffix", "left").groupBy("input").agg(F.max(F.when(exact, F.col("id"))).alias("exact"), F.min("id").alias("one"), F.count("id").alias("n"))
    status = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return hits.select("input", F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("id"), status.alias("status"), F.col("n").alias("matches"))


# Sizes and turns of the layout.
NODE_RADIUS = (4, 18)
GOLDEN, MARGIN, TITLE_SHIFT = 1.618, 25, 10
CELL, LEAST_WIDTH, LEAST_HEIGHT, TITLE_HEIGHT = 30, 120, 80, 20
TOP, ROW_GAP, COLUMN_GAP, WRAP_AT = 60.0, 20, 15, 1200
CANVAS = (800, 600)


def spiral(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """nodes (id, type, module, entry, complexity, ord) with x, y, radius and colour in their module's box (module, x, y, width, height): a spiral, entries first, then by complexity."""
    keyed = nodes.withColumns({"_e": F.when(F.col("entry"), 0).otherwise(1), "_c": -F.col("complexity")})
    rows = row_numbers(keyed, ["module"], ["_e", "_c", "ord"], "_i").withColumn("_i", F.col("_i") - 1)
    rows = rows.join(nodes.groupBy("module").agg(F.count(F.lit(1)).alias("_n")), "module")
    rows = rows.join(boxes.select("module", F.col("x").alias("_x"), F.col("y").alias("_y"), "width", "height"), "module")
    angle = F.col("_i") * (2 * F.pi() / F.col("_n")) * GOLDEN
    r = F.when(F.col("_n") == 1, 0.0).otherwise((F.least("width", "height") / 2 - MARGIN) * F.sqrt(F.col("_i") + 1) / F.sqrt("_n"))
    return rows.select("id", "module", (F.col("_x") + F.col("width") / 2 + r * F.cos(angle)).alias("x"), (F.col("_y") + F.col("height") / 2 + TITLE_SHIFT + r * F.sin(angle)).alias("y"), (NODE_RADIUS[0] + (NODE_RADIUS[1] - NODE_RADIUS[0]) * F.least("complexity", F.lit(1.0))).alias("radius"), type_colour(F.col("type")).alias("colour"), complexity_colour(F.col("complexity")).alias("heat"))


def _row_starts(boxes: DataFrame, columns: int, padding: int, sure: int) -> DataFrame:
    """start: the numbers of the first boxes of rows, of boxes (i, width) that are few.

    Each box's next row start, were it one itself, is found in prefix sums of widths; rows
    follow by pointer doubling, in as many rounds as the number of rows has bits.
    """
    ends = boxes.select("i", "width", F.sum(F.col("width") + COLUMN_GAP).over(Window.orderBy("i")).alias("_end"))
    from_ = ends.select(F.col("i").alias("start"), (F.col("_end") - F.col("width") - COLUMN_GAP).alias("_begin"), F.explode(F.sequence(F.col("i") + columns, F.col("i") + max(columns, sure))).alias("i"))
    beyond = from_.join(ends, "i").where(padding + F.col("_end") - COLUMN_GAP - F.col("_begin") > WRAP_AT)
    jump = settled(beyond.groupBy("start").agg(F.min("i").alias("_next")))
    starts = boxes.where("i = 1").select(F.col("i").alias("start"))
    # A row has so many boxes or more, and there are at most so many rows.
    for _ in range(columns.bit_length()):
        starts = settled(starts.union(starts.join(jump, "start").select("_next")))
        jump = settled(jump.join(jump.select(F.col("start").alias("_next"), F.col("_next").alias("_after")), "_next").select("start", F.col("_after").alias("_next")))
    return starts


def grid(modules: DataFrame, padding: int = 40, inner: int = 20) -> DataFrame:
    """modules (module, files, lines) with x, y, width, height: rows of boxes, the longest first.

    A row ends before the first box that has as many before it in the row as the root of their
    number, and that would reach beyond WRAP_AT. No box is narrower than LEAST_WIDTH, so from
    eight a row on (50 boxes) that many boxes always reach beyond it: all rows are equally long,
    and a row is what a task places. Fewer boxes get their rows by pointer doubling.
    """
    rows = F.ceil(F.sqrt("files"))
    sized = modules.where("files > 0").select("module", (-F.col("lines")).alias("_o"), F.greatest(rows * CELL + inner * 2, F.lit(LEAST_WIDTH)).cast("double").alias("width"), F.greatest(F.ceil(F.col("files") / rows) * CELL + inner * 2 + TITLE_HEIGHT, F.lit(LEAST_HEIGHT)).cast("double").alias("height"))
    placed = settled(row_numbers(sized, [], ["_o", "module"], "i"))
    n = placed.count()
    columns = math.isqrt(n - 1) + 1 if n else 1
    sure = (WRAP_AT - padding - LEAST_WIDTH) // (LEAST_WIDTH + COLUMN_GAP) + 1
    if columns >= sure:
        placed = placed.withColumn("_row", F.col("i") - F.pmod(F.col("i") - 1, F.lit(columns)))
    else:
        starts = _row_starts(placed, columns, padding, sure)
        placed = placed.join(starts.withColumn("i", F.col("start")), "i", "left").withColumn("_row", F.max("start").over(Window.orderBy("i"))).drop("start")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    down = placed.groupBy("_row").agg(F.max("height").alias("_h"))
    down = down.select("_row", (TOP + F.coalesce(F.sum(F.col("_h") + ROW_GAP).over(before(Window.orderBy("_row"))), F.lit(0.0))).alias("y"))
    across = padding + F.coalesce(F.sum(F.col("width") + COLUMN_GAP).over(before(Window.partitionBy("_row").orderBy("i"))), F.lit(0.0))
    return placed.withColumn("x", across).join(down, "_row").select("module", "x", "y", "width", "height")


def canvas(boxes: DataFrame, padding: int = 60) -> DataFrame:
    """One row: width, height of what shows all boxes, CANVAS at least."""
    side = lambda at, size, least: F.greatest(F.coalesce(F.max(F.col(at) + F.col(size)) + padding, F.lit(0.0)), F.lit(float(least)))
    return boxes.agg(side("x", "width", CANVAS[0]).alias("width"), side("y", "height", CANVAS[1]).alias("height"))


def drawn_links(edges: DataFrame, placed: DataFrame, least: float = 20.0) -> DataFrame:
    """src, dst, x1, y1, x2, y2 of the edges between placed files (id, x, y) that are not nearer than that."""
    of = lambda c, n: placed.select(F.col("id").alias(c), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    both = edges.select("src", "dst").join(of("src", 1), "src").join(of("dst", 2), "dst")
    return both.where(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) >= least)


def module_links(coupling: DataFrame, boxes: DataFrame) -> DataFrame:
    """coupling's rows (from_module, to_module) between placed boxes, with the middles of both, rounded."""
    mid = lambda a, b: F.floor(F.col(a) + F.col(b) / 2 + 0.5).cast("long")
    of = lambda c, n: boxes.select(F.col("module").alias(c), mid("x", "width").alias(f"x{n}"), mid("y", "height").alias(f"y{n}"))
    return coupling.join(of("from_module", 1), "from_module").join(of("to_module", 2), "to_module")
