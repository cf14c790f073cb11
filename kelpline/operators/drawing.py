"""What drawings of a layout show, as rows: contours of modules, and roads between them.

boxes are of resolve.grid(), placed files (id, module, x, y) of resolve.spiral().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flow_category
from ..functions.render import complexity_colour, fixed

# Sizes of rings and roads, and roads' colours.
MOST_RINGS, RING_REACH, RING_SHIFT, PEAK = 6, 0.85, 5, 0.15
LEAST_LENGTH, BEND, LABEL_FROM = 15.0, 15, 3
FLOW_COLOURS = {"auth": "#F4A261", "payment": "#E63946", "data": "#457B9D", "rendering": "#52B788"}


def flow_colour(flow):
    return F.create_map(*[F.lit(x) for kv in FLOW_COLOURS.items() for x in kv])[flow]


def contours(boxes: DataFrame, modules: DataFrame, complexity: DataFrame) -> DataFrame:
    """module, ring, cx, cy, rx, ry, colour, opacity: ellipses around a module's middle, more of them and warmer ones where it has more files (modules: module, files) that are more complex (complexity: module, complexity). Ring 0 is the filled peak; the last ring is the outermost."""
    rows = boxes.join(modules.select("module", "files"), "module").join(complexity.select("module", "complexity"), "module")
    rings = F.least(F.greatest(F.floor(F.col("complexity") * 5 + F.col("files") / 8 + 0.5), F.lit(1)), F.lit(MOST_RINGS)).cast("int")
    rows = rows.withColumn("_n", rings).withColumn("ring", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    share = F.col("ring") / F.col("_n")
    size = F.when(F.col("ring") == 0, PEAK).otherwise(share)
    return rows.select(
        "module", "ring", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2 + RING_SHIFT).alias("cy"),
        (F.col("width") / 2 * RING_REACH * size).alias("rx"), (F.col("height") / 2 * RING_REACH * size).alias("ry"),
        complexity_colour(F.col("complexity") * F.when(F.col("ring") == 0, 1.0).otherwise(share)).alias("colour"), F.when(F.col("ring") == 0, 0.3).otherwise(0.1 + (1 - share) * 0.2).alias("opacity"),
    )


def flow_links(edges: DataFrame, placed: DataFrame, least: float = LEAST_LENGTH) -> DataFrame:
    """src, dst, ord, flow, from_module, to_module, x1, y1, x2, y2 of edges that are no tests, between files that far apart or farther."""
    of = lambda c, m, n: placed.select(F.col("id").alias(c), F.col("module").alias(m), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    both = edges.where("type <> 'tests'").select("src", "dst", "ord").join(of("src", "from_module", 1), "src").join(of("dst", "to_module", 2), "dst")
    far = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) >= least
    return both.where(far).withColumn("flow", flow_category(F.col("src"), F.col("dst")))


def roads(links: DataFrame, boxes: DataFrame) -> DataFrame:
    """a, b, n, first, flow, the ends' and the bend's places, thickness, opacity: flow_links() between two modules in both directions as one curve, bent aside from its middle by BEND.

    Its flow is that of most of its links, of several such the one that is met first.
    """
    a, b = F.least("from_module", "to_module"), F.greatest("from_module", "to_module")
    per = links.where(F.col("from_module") != F.col("to_module")).groupBy(a.alias("a"), b.alias("b"), "flow").agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first"))
    pairs = per.groupBy("a", "b").agg(F.sum("_n").alias("n"), F.min("_first").alias("first"), F.max_by("flow", F.struct("_n", (-F.col("_first")).alias("_k"))).alias("flow"))
    mid = lambda c, n: boxes.select(F.col("module").alias(c), (F.col("x") + F.col("width") / 2).alias(f"x{n}"), (F.col("y") + F.col("height") / 2).alias(f"y{n}"))
    rows = pairs.join(mid("a", 1), "a").join(mid("b", 2), "b")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    return rows.withColumns({
        "mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2, "thickness": F.least(1 + F.col("n") * 0.5, F.lit(5.0)), "opacity": F.least(0.3 + F.col("n") * 0.05, F.lit(0.7)),
    }).withColumns({"bx": F.col("mx") - dy / length * BEND, "by": F.col("my") + dx / length * BEND})


def road_paths(roads: DataFrame) -> DataFrame:
    """roads() with path, an SVG element, and label, the one with its number of links from LABEL_FROM on."""
    one = lambda c: fixed(F.col(c) if isinstance(c, str) else c, 1)
    colour = flow_colour(F.col("flow"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    path = text('<path d="M', one("x1"), ",", one("y1"), " Q", one("bx"), ",", one("by"), " ", one("x2"), ",", one("y2"), '" fill="none" stroke="', colour, '" stroke-width="', one("thickness"), '" opacity="', fixed(F.col("opacity"), 2), '" marker-end="url(#arrow-', F.col("flow"), ')"/>')
    label = text('<text x="', one("mx"), '" y="', one(F.col("my") - 5), '" text-anchor="middle" font-family="monospace" font-size="7" fill="', colour, '" opacity="0.7">', F.col("n").cast("string"), "</text>")
    return roads.withColumns({"path": path, "label": F.when(F.col("n") >= LABEL_FROM, label)})
