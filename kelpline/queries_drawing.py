"""Queries of drawings over the star tables' layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import kept
from .functions.render import COMPLEXITY_COLOURS
from .operators import drawing as D
from .operators import modules as M
from .operators import resolve as R
from .plans import drawing as W
from .queries import _BOXES, _CAT, _FLOW, _SPIRAL, MOD, _complex, _graph, _placed, _turned, query
from .queries_reports import _NUMBERED, _report, _said, _texts, _up
from .queries_reports import _placed as _numbered

_HEX = "('0x' || substr({0}, {1}, 2))::int"
_BLEND = " || ',' || ".join(f"floor({_HEX.format('p', i)} + ({_HEX.format('q', i)} - {_HEX.format('p', i)}) * (spot - step) + 0.5)::bigint" for i in (2, 4, 6))


@query(f"""with recursive {_BOXES},
mean as (select {MOD.format("id")} as module, avg(complexity) as complexity, count(*) as files from cx group by 1),
n as (select *, least(greatest(floor(complexity * 5 + files / 8 + 0.5), 1), 6)::int as n from boxes join mean using (module)),
r as (select *, ring::double / n as share from (select *, unnest(range(0, n + 1))::int as ring from n)),
c as (select *, greatest(0, least(1, complexity * case ring when 0 then 1 else share end)) * 5 as spot from r),
s as (select *, least(floor(spot), 4)::int as step from c),
p as (select *, {list(COMPLEXITY_COLOURS)}[step + 1] as p, {list(COMPLEXITY_COLOURS)}[step + 2] as q from s)
select module, ring, x + width / 2 as cx, y + height / 2 + 5 as cy, round(width / 2 * 0.85 * case ring when 0 then 0.15 else share end, 6) as rx, round(height / 2 * 0.85 * case ring when 0 then 0.15 else share end, 6) as ry,
       'rgb(' || {_BLEND} || ')' as colour, round(case ring when 0 then 0.3 else 0.1 + (1 - share) * 0.2 end, 6) as opacity from p""")
def terrain_rings(spark, sf_dir):
    """Sizes to six decimals."""
    nodes, edges = _graph(spark, sf_dir)
    found = M.modules(nodes, edges)
    rows = D.contours(R.grid(found), found, M.mean_complexity(_complex(nodes, edges)))
    return rows.withColumns({c: F.round(c, 6) for c in ("rx", "ry", "opacity")})


_ROADS = f"""{_SPIRAL},
far as (
  select e.k * 10000000000 + e.t as ord, least(s.module, d.module) as a, greatest(s.module, d.module) as b, {_FLOW.format("src || ' ' || dst")} as flow
  from edges e join spiral s on s.id = src join spiral d on d.id = dst where e.type <> 'tests' and s.module <> d.module and round(sqrt((d.x - s.x) ** 2 + (d.y - s.y) ** 2), 6) >= 15),
per as (select a, b, flow, count(*) as n, min(ord) as first from far group by 1, 2, 3),
pair as (select a, b, sum(n)::bigint as n, arg_max(flow, (n, -first)) as flow from per group by 1, 2),
ends as (select pair.*, p.x + p.width / 2 as x1, p.y + p.height / 2 as y1, q.x + q.width / 2 as x2, q.y + q.height / 2 as y2 from pair join boxes p on p.module = a join boxes q on q.module = b),
bent as (select *, (x1 + x2) / 2 as mx, (y1 + y2) / 2 as my, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) as length from ends)"""


@query(f"""with recursive {_ROADS}
select a, b, n, flow, x1, y1, x2, y2, round(mx - (y2 - y1) / length * 15, 6) as bx, round(my + (x2 - x1) / length * 15, 6) as "by", least(1 + n * 0.5, 5)::double as thickness, round(least(0.3 + n * 0.05, 0.7), 6)::double as opacity,
       case when n >= 3 then '>' || n || '</text>' end as label from bent""")
def infrastructure_paths(spark, sf_dir):
    """Places to six decimals; of a label its end."""
    nodes, edges = _graph(spark, sf_dir)
    boxes = kept(R.grid(M.modules(nodes, edges)))
    placed, _ = _placed(spark, sf_dir)
    rows = D.road_paths(D.roads(D.flow_links(edges, placed, D.LEAST_LENGTH - 5e-7), boxes))
    six = lambda c: F.round(c, 6).alias(c)
    return rows.select("a", "b", "n", "flow", "x1", "y1", "x2", "y2", six("bx"), six("by"), "thickness", six("opacity"), F.regexp_extract("label", r">\d+</text>", 0).alias("label"))


def _at(x, y):
    return f"'@(' || floor({x} + 0.5)::bigint || ',' || floor({y} + 0.5)::bigint || ')'"


_LAST = "split_part({0}, '/', -1)"
_SIZE = f"' ' || lines || 'L complexity:' || {_up('complexity')}"
_SPATIAL = [
    _texts(0, "# star — Spatial Encoding", k1="0"),
    _said("total", 0, "'# Canvas: ' || w::bigint || '×' || h::bigint || ' | ' || n || ' files | ' || format('{:,}', l) || ' lines | ' || m || ' modules'", "0", sub="1"),
    _said("total", 0, "'# Positions encode spatial layout — nearby coordinates = related code'", "0", sub="2"),
    _said("total", 0, "''", "0", sub="3"),
    _texts(1, "## Modules"),
    _said("mods", 1, f"'- ' || {_LAST.format('module')} || ' (' || module || ') ' || {_at('x', 'y')} || ' ' || width::bigint || '×' || height::bigint || ': ' || files || ' files, ' || format('{{:,}}', lines) || ' lines [complexity: ' || {_up('complexity')} || ']' || case when entries > 0 then ' [' || entries || ' entry points]' else '' end", "-lines", k3="module"),
]
for _n, _title, _type, _line in (
    (2, "API Routes", "api-route", f"array_to_string(methods, ', ') || ' ' || route || ' ' || {_at('x', 'y')} || {_SIZE} || case when n_imports > 8 then ' — ' || n_imports || ' imports' else '' end"),
    (3, "Pages", "route", f"route || case when client then ' [client]' else '' end || ' ' || {_at('x', 'y')} || {_SIZE}"),
    (4, "Components", "component", f"{_LAST.format('id')} || ' ' || {_at('x', 'y')} || {_SIZE}"),
):
    _SPATIAL += [
        _said(f"(select count(*) as n from f where type = '{_type}')", _n, "''", sub="-1"),
        _said(f"(select count(*) as n from f where type = '{_type}')", _n, f"'## {_title} (' || n || ')'"),
        _said(f"(select * from f where type = '{_type}' order by complexity desc, ord{' limit 20' if _n == 4 else ''})", _n, "'- ' || " + _line, "-complexity", "ord"),
    ]
_SPATIAL += [
    _said("(select count(*) - 20 as n from f where type = 'component') where n > 0", 4, "'  ... and ' || n || ' more'", "1e9"),
    _said("(select 1)", 5, "''", sub="-1"), _texts(5, "## Flows (inter-module edges)"),
    _said("flow join boxes p on p.module = a join boxes q on q.module = b", 5, f"'- ' || {_LAST.format('a')} || ' ' || {_at('p.x', 'p.y')} || ' ' || case when n >= 10 then '═══' when n >= 5 then '───' else '···' end || '> ' || {_LAST.format('b')} || ' ' || {_at('q.x', 'q.y')} || ': ' || n || ' edges [' || kinds || ']'", "-n", "first"),
    _said("(select 1)", 6, "''", sub="-1"), _texts(6, "## Complexity Hotspots"),
    _said("(select * from f where type not in ('test', 'config') order by complexity desc, ord limit 10)", 6, f"'- ' || {_at('x', 'y')} || ' ' || id || ' — ' || lines || 'L, ' || n_imports || ' imports'", "-complexity", "ord"),
    _said("(select 1)", 7, "''", sub="-1"), _texts(7, "## Most Depended-On"),
    _said("(select dst, count(*) as n, min(k * 10000000000 + t) as first from edges group by 1 order by n desc, first limit 10) d join f on id = dst", 7, f"'- ' || id || ' ' || {_at('x', 'y')} || ' — imported by ' || n", "-n", "first"),
    _said("(select 1)", 8, "''", sub="-1"), _texts(8, "## Test Coverage"),
    _said("cov", 8, f"e || ' test files | ' || t || '/' || n || ' testable files with direct test edges (' || {_up('t * 100.0 / n', 1)} || '%)'", "0"),
]


@query(f"""with recursive {_SPIRAL},
f as (select cx.*, s.x, s.y from cx join spiral s on s.id = cx.id),
mods as (
  select b.*, files, lines, complexity, entries from boxes b join sized using (module) join (
    select {MOD.format("cx.id")} as module, avg(complexity) as complexity, count(entry.dst) as entries from cx left join entry on entry.dst = cx.id group by 1) using (module)),
total as (select (select greatest(max(x + width) + 60, 800) from boxes) as w, (select greatest(max(y + height) + 60, 600) from boxes) as h, count(*) as n, sum(lines)::bigint as l, (select count(*) from boxes) as m from nodes),
kinds as (select {MOD.format("src")} as a, {MOD.format("dst")} as b, {_CAT.format("src || ' ' || dst")} as c, count(*) as n, min(k * 10000000000 + t) as first from edges where {MOD.format("src")} <> {MOD.format("dst")} group by 1, 2, 3),
flow as (select a, b, sum(n)::bigint as n, min(first) as first, string_agg(c || ':' || n, ' ' order by n desc, first) as kinds from kinds group by 1, 2),
cov as (select (select count(*) from edges where type = 'tests') as e, (select count(distinct dst) from edges where type = 'tests') as t, count(*) as n from nodes where type not in ('test', 'config'))
{_NUMBERED.format(_report(_SPATIAL))}""")
def spatial_text(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    rows, found = kept(_complex(nodes, edges)), kept(M.modules(nodes, edges))
    boxes = kept(R.grid(found))
    return _numbered(W.spatial_text("star", rows, edges, found, M.mean_complexity(rows), boxes, kept(_turned(rows, edges, boxes)), M.coverage(nodes, edges)))
