import math
import random

import pytest

from kelpline.operators import drawing as D
from kelpline.operators import resolve as R


def folded(sizes, padding, inner):
    """Boxes one after the other: (x, y) by name of (name, files, lines)."""
    out, x, y, high, col = {}, padding, 60, 0, 0
    kept = sorted((s for s in sizes if s[1] > 0), key=lambda s: (-s[2], s[0]))
    for name, files, _ in kept:
        across = math.ceil(math.sqrt(files))
        width, height = max(across * 30 + 2 * inner, 120), max(math.ceil(files / across) * 30 + 2 * inner + 20, 80)
        if col >= math.ceil(math.sqrt(len(kept))) and x + width > 1200:
            x, y, high, col = padding, y + high + 20, 0, 0
        out[name] = (x, y, width, height)
        x, high, col = x + width + 15, max(high, height), col + 1
    return out


@pytest.mark.parametrize(("n", "most", "padding", "inner"), [(0, 1, 40, 20), (1, 9, 40, 20), (7, 900, 60, 30), (30, 3, 40, 20), (49, 60, 40, 20), (50, 2, 40, 20), (130, 400, 60, 30)])
def test_grid_is_the_fold(spark, n, most, padding, inner):
    rng = random.Random(n)
    sizes = [(f"m{i:03}", rng.randint(0 if i else 1, most), rng.randint(1, 40)) for i in range(n)]
    boxes = R.grid(spark.createDataFrame(sizes, "module string, files long, lines long"), padding, inner)
    assert {r.module: (r.x, r.y, r.width, r.height) for r in boxes.collect()} == folded(sizes, padding, inner)
    one = R.canvas(boxes).first()
    places = folded(sizes, padding, inner).values()
    assert (one.width, one.height) == (max([800] + [p[0] + p[2] + 60 for p in places]), max([600] + [p[1] + p[3] + 60 for p in places]))


def boxes(spark):
    return spark.createDataFrame([("a", 60.0, 60.0, 120.0, 80.0), ("b", 195.0, 60.0, 200.0, 140.0), ("c", 60.0, 220.0, 120.0, 80.0)], "module string, x double, y double, width double, height double")


def test_contours(spark):
    files = spark.createDataFrame([("a", 1), ("b", 40), ("c", 9)], "module string, files long")
    heat = spark.createDataFrame([("a", 0.0), ("b", 0.9), ("c", 0.2)], "module string, complexity double")
    got = {(r.module, r.ring): r for r in D.contours(boxes(spark), files, heat).collect()}
    assert {m: max(r for n, r in got if n == m) for m in "abc"} == {"a": 1, "b": 6, "c": 2}
    last, peak = got["b", 6], got["b", 0]
    assert (last.cx, last.cy, round(last.rx, 6), round(last.ry, 6), round(last.opacity, 6)) == (295, 135, 85, 59.5, 0.1)
    assert (round(peak.rx, 6), round(peak.ry, 6), peak.opacity, peak.colour) == (12.75, 8.925, 0.3, last.colour)
    assert got["a", 1].colour == "rgb(45,106,79)" and got["a", 0].colour == "rgb(45,106,79)"


def test_roads(spark):
    placed = spark.createDataFrame([("auth.ts", "a", 100.0, 100.0), ("x.ts", "b", 290.0, 130.0), ("y.ts", "b", 300.0, 130.0), ("z.ts", "c", 100.0, 110.0), ("q.ts", "c", 100.0, 260.0)], "id string, module string, x double, y double")
    links = [("x.ts", "auth.ts", "imports", 1), ("y.ts", "auth.ts", "imports", 2), ("auth.ts", "x.ts", "imports", 3), ("x.ts", "q.ts", "imports", 4), ("x.ts", "y.ts", "imports", 5), ("auth.ts", "z.ts", "imports", 6), ("q.ts", "auth.ts", "tests", 7)]
    edges = spark.createDataFrame(links, "src string, dst string, type string, ord long")
    far = D.flow_links(edges, placed)
    # Nearer than 15 go, and so do tests.
    assert sorted(r.ord for r in far.collect()) == [1, 2, 3, 4]
    got = {(r.a, r.b): r for r in D.road_paths(D.roads(far, boxes(spark))).collect()}
    assert set(got) == {("a", "b"), ("b", "c")}
    one, two = got["a", "b"], got["b", "c"]
    dx, dy = 295 - 120, 130 - 100
    length = math.hypot(dx, dy)
    bend = (207.5 - dy / length * 15, 115 + dx / length * 15)
    assert one.path == f'<path d="M120.0,100.0 Q{bend[0]:.1f},{bend[1]:.1f} 295.0,130.0" fill="none" stroke="#F4A261" stroke-width="2.5" opacity="0.45" marker-end="url(#arrow-auth)"/>'
    assert one.label.endswith('y="110.0" text-anchor="middle" font-family="monospace" font-size="7" fill="#F4A261" opacity="0.7">3</text>')
    assert (two.n, two.flow, two.label) == (1, "data", None)


def test_a_road_has_the_flow_of_most_links_or_the_first(spark):
    rows = [(1, "data", "a", "b"), (2, "auth", "b", "a"), (3, "auth", "a", "b"), (4, "payment", "a", "c"), (5, "data", "c", "a")]
    links = spark.createDataFrame(rows, "ord long, flow string, from_module string, to_module string")
    assert {(r.b, r.n, r.flow) for r in D.roads(links, boxes(spark)).collect()} == {("b", 3, "auth"), ("c", 2, "payment")}
