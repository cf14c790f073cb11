"""The queries over the star tables, each with SQL that says the same; whole tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import grows, kept, settled, table
from .functions import columns as C
from .functions import extract as X
from .functions import render
from .operators import experiments as E
from .operators import graph as G
from .operators import history as H
from .operators import modules as M
from .operators import resolve as R
from .plans import check as P
from .sources import star

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# What sources/star.py derives, in SQL.
_TYPE = "case p_type " + " ".join(f"when '{k}' then '{v[0]}'" for k, v in star.TYPES.items()) + " end"
_FOLDER = "case p_type " + " ".join(f"when '{k}' then '{v[1]}'" for k, v in star.TYPES.items()) + " end"
NODES = f"""
nodes as (
  select p_partkey as ord, lower(replace(p_brand, '#', '')) || '/' || {_FOLDER} || '/' || replace(p_name, ' ', '-') || '-' || p_partkey || '.ts' as id,
         {_TYPE} as type, floor(p_retailprice)::int as lines, p_name, string_split(p_name, ' ') as exports,
         case when p_partkey % 2 = 0 then ['GET', 'POST'] else ['DELETE'] end as methods, '/' || {_FOLDER} || '/' || p_partkey as route, p_partkey % 3 = 0 as client
  from part)"""
EDGES = f"""{NODES},
o1 as (select l_orderkey, min(l_partkey) as m1 from lineitem group by 1),
o2 as (select l_orderkey, m1, min(case when l_partkey > m1 then l_partkey end) as m2 from lineitem join o1 using (l_orderkey) group by 1, 2),
ab as (select l_partkey as k, min(m1) as a, min(m2) as b from lineitem join o2 using (l_orderkey) group by 1),
kt as (select k, a as t from ab where a < k union select k, b from ab where b < k),
edges as (
  select s.id as src, d.id as dst, case when s.type = 'test' then 'tests' else 'imports' end as type, k, t
  from kt join nodes s on s.ord = k join nodes d on d.ord = t)"""
MOD = "case when len(string_split({0}, '/')) > 2 then string_split({0}, '/')[1] || '/' || string_split({0}, '/')[2] else string_split({0}, '/')[1] end"
REACH = f"""{EDGES},
links as (select distinct dst as node, src as next from edges where type <> 'tests' and src not in (select id from nodes where type = 'test')),
walk(root, node, depth) as (
  select distinct node, node, 0 from links
  union
  select w.root, l.next, w.depth + 1 from walk w join links l on l.node = w.node where l.next <> w.root and w.depth < 40),
reach as (select root, node, min(depth) as depth from walk where depth > 0 group by 1, 2),
direct as (select node, count(distinct next) as direct from links group by 1),
risk as (
  select d.node, d.direct, count(r.node) as affected, floor(round(sum(power(0.7, r.depth)), 9) * 100 + 0.5) / 100 as weighted,
         count(distinct {MOD.format("r.node")}) as modules, max(r.depth)::bigint as max_depth,
         floor(count(r.node)::double / d.direct * 100 + 0.5) / 100 as amplification
  from direct d join reach r on r.root = d.node group by 1, 2)"""
TRIALS = """
trials as (
  select event_type as condition, case event_type when 'view' then 'Full view' else event_type end as condition_name, case when event_id // 16 % 2 = 0 then 'one' else 'two' end as codebase,
         user_id as question, (props->>'$.k')::bigint % 3 as assertion, event_id as trial,
         case when value < 30 then 'PASS' when value < 60 then 'PARTIAL' else 'FAIL' end as verdict,
         case when value < 30 then 1.0 when value < 60 then 0.5 else 0.0 end::double as s, value as latency,
         case when (props->>'$.k')::bigint % 4 > 0 then (props->>'$.k')::bigint % 7 end as tools, user_id + 100 as tokens_in, length(props)::bigint as tokens_out, ts
  from events),
scores as (select condition, question, codebase, avg(s) as score, min(trial) as ord from trials group by 1, 2, 3),
arms as (select condition, min(ord) as first from scores group by 1),
pairs as (select x.condition as a, y.condition as b from arms x join arms y on (x.first, x.condition) < (y.first, y.condition)),
rates as (
  select codebase, question, assertion, condition, avg(s) as rate, avg((verdict = 'PASS')::int) as passed, count(*) as n, list(s order by trial) as verdicts, min(trial) as ord,
         case when avg(s) = 0 then 0 else stddev_pop(s) / avg(s) end as cv, min(min(trial)) over (partition by codebase, question, condition) as seen
  from trials group by 1, 2, 3, 4)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = kept(star.parts(spark, sf_dir))
    return nodes, kept(star.edges(spark, sf_dir, nodes))


def _complex(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_imports"))
    return M.complexity(nodes.join(grows(out), "id", "left").na.fill(0, ["n_imports"]))


COMPLEX = f"""{EDGES},
deg as (select n.*, coalesce(c, 0) as n_imports from nodes n left join (select src, count(*) as c from edges group by 1) on src = id),
pct as (select quantile_cont(lines::double, 0.95) as pl, quantile_cont(n_imports::double, 0.95) as pi from deg),
cx as (
  select deg.*, floor((0.6 * case when pl > 0 then least(lines / pl, 1.0) else 0 end + 0.4 * case when pi > 0 then least(n_imports / pi, 1.0) else 0 end) * 100 + 0.5) / 100 as complexity
  from deg, pct)"""


# --- the graph


@query(f"with recursive {REACH} select node, direct, affected, weighted, modules, max_depth, amplification from risk where affected > 1")
def blast_radius_all(spark, sf_dir):
    return G.blast_radius(*_graph(spark, sf_dir)).where("affected > 1").drop("module_names")


@query(f"with recursive {REACH} select root as node, string_agg(distinct {MOD.format('node')}, ',' order by {MOD.format('node')}) as module_names from reach group by 1")
def blast_radius_modules(spark, sf_dir):
    return G.blast_radius(*_graph(spark, sf_dir)).where("affected > 0").select("node", F.array_join("module_names", ",").alias("module_names"))


@query(f"with recursive {REACH} select root, max(depth)::bigint as max_depth, max(depth)::bigint as steps from reach group by 1")
def cascade_path(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    roots = edges.select(F.col("dst").alias("id")).distinct()
    got = G.cascade_paths(edges, nodes, roots)
    return got.select("root", "max_depth", F.size("path").cast("long").alias("steps"))


@query(f"""with recursive {EDGES},
links as (select distinct dst as node, src as next from edges),
walk(root, node, depth) as (
  select distinct node, node, 0 from links
  union
  select w.root, l.next, w.depth + 1 from walk w join links l on l.node = w.node where l.next <> w.root and w.depth < 40),
reach as (select root, node, min(depth) as depth from walk where depth > 0 group by 1, 2)
select root, r.node as test, case when depth = 1 then 'direct' else 'transitive' end as kind, depth > 1 as has_via
from reach r join nodes n on n.id = r.node where n.type = 'test'""")
def test_map(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.test_map(edges, nodes, edges.select(F.col("dst").alias("id")).distinct()).select("root", "test", "kind", F.col("via").isNotNull().alias("has_via"))


@query(f"""with recursive {REACH},
keep as (select r.*, n.ord, {MOD.format("r.node")} as module from risk r join nodes n on n.id = r.node where affected > 1 and n.type <> 'test'),
top as (
  select *, count(*) over (partition by module) as n, row_number() over (partition by module order by amplification desc, ord) as k from keep),
placed as (select *, row_number() over (order by amplification desc, ord) as place from top where k = 1)
select case when place <= 5 then 1 else 2 end::bigint as tier, place::bigint as place, node, amplification, case when place <= 5 then n - 1 else 0 end::bigint as similar
from placed where place <= 8""")
def risk_tiers(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.risk_tiers(G.blast_radius(nodes, edges), nodes)


@query(f"with {EDGES} select dst as node, count(*) as importers, count(*) filter (type = 'tests') as tests from edges group by 1")
def inbound_counts(spark, sf_dir):
    return M.inbound(star.edges(spark, sf_dir))


@query(f"""with {EDGES} select dst as node, count(*) as importers from edges join nodes s on s.id = src join nodes d on d.id = dst
where edges.type <> 'tests' and s.type <> 'test' and d.type <> 'test' group by 1 order by 2 desc, 1 limit 8""")
def most_imported(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return M.most_imported(edges, nodes)


@query(f"with {EDGES} select src, dst, type, floor(1 / ln(1 + count(*) over (partition by dst)) * 100 + 0.5) / 100 as weight from edges")
def edge_weights(spark, sf_dir):
    return M.weighted(star.edges(spark, sf_dir)).select("src", "dst", "type", "weight")


@query(f"with {COMPLEX} select id, lines, n_imports, complexity from cx")
def complexity_p95(spark, sf_dir):
    return _complex(*_graph(spark, sf_dir)).select("id", "lines", "n_imports", "complexity")


@query(f"with {COMPLEX} select id, complexity from cx where type not in ('test', 'config') and complexity > 0.3 order by complexity desc, id limit 10")
def hotspots(spark, sf_dir):
    return _complex(*_graph(spark, sf_dir)).where("type not in ('test', 'config') and complexity > 0.3").select("id", "complexity").orderBy(F.desc("complexity"), "id").limit(10)


@query(f"""with {EDGES},
entry as (select distinct dst from edges where {MOD.format("src")} <> {MOD.format("dst")})
select {MOD.format("id")} as module, count(*) as files, sum(lines)::bigint as lines, count(dst) as entries from nodes left join entry on dst = id group by 1""")
def module_stats(spark, sf_dir):
    return M.modules(*_graph(spark, sf_dir))


_CAT = """case when regexp_matches({0}, 'auth|session|login|magic-link|trusted-device|verify') then 'auth'
  when regexp_matches({0}, 'payment|authorize|order|cart|price|tip') then 'payment' when regexp_matches({0}, 'test|spec|__tests__') then 'test'
  when regexp_matches({0}, 'component|page|layout|\\.tsx$') then 'rendering' else 'data' end"""
_FLOW = """case when regexp_matches({0}, 'auth|session|login|magic-link|trusted-device|verify') then 'auth'
  when regexp_matches({0}, 'payment|authorize|order|cart|price|tip') then 'payment' when regexp_matches({0}, 'prisma|schema|queries|api/|lib/') then 'data'
  when regexp_matches({0}, 'component|page|layout|\\.tsx$') then 'rendering' else 'data' end"""


@query(f"""with {EDGES} select {MOD.format("src")} as from_module, {MOD.format("dst")} as to_module, {_CAT.format("src || ' ' || dst")} as category, count(*) as n
from edges where {MOD.format("src")} <> {MOD.format("dst")} group by 1, 2, 3""")
def module_coupling(spark, sf_dir):
    return M.coupling(star.edges(spark, sf_dir))


@query(f"""with {EDGES},
r as (
  select least({MOD.format("src")}, {MOD.format("dst")}) as module_a, greatest({MOD.format("src")}, {MOD.format("dst")}) as module_b, {_FLOW.format("src || ' ' || dst")} as category, count(*) as k
  from edges where {MOD.format("src")} <> {MOD.format("dst")} group by 1, 2, 3)
select module_a, module_b, n, category
from (select *, sum(k) over (partition by module_a, module_b)::bigint as n, row_number() over (partition by module_a, module_b order by k desc, category) as i from r) where i = 1""")
def module_roads(spark, sf_dir):
    return M.roads(star.edges(spark, sf_dir))


@query(f"""with {EDGES}
select (select count(*) from nodes where type = 'test') as test_files, (select count(*) from nodes where type not in ('test', 'config')) as testable,
       count(*) as test_edges, count(distinct dst) as tested from edges where type = 'tests'""")
def test_coverage(spark, sf_dir):
    return M.coverage(*_graph(spark, sf_dir))


@query(f"""with {COMPLEX},
e as (select s.id as src, s.ord, s.complexity as c1, s.lines as l1, d.id as dst from edges join cx s on s.id = src join cx d on d.id = dst
      where edges.type <> 'tests' and s.type = 'api-route' and {MOD.format("src")} <> {MOD.format("dst")}),
p as (select src, ord, c1, l1, count(*) as deps from e group by 1, 2, 3, 4)
select 'data' as domain, row_number() over (order by c1 desc, l1 desc, ord)::bigint as place, src as entry, deps from p qualify place <= 3""")
def flows_top(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return M.flows(_complex(nodes, edges), edges)


_CONV = f"""{NODES},
of as (select id, type from nodes where type not in ('test', 'config', 'schema')),
tot as (select type, count(*) as total from of group by 1 having count(*) >= 3),
typed as (
  select distinct id, of.type, 'shared/' || l_returnflag || l_linenumber || '.ts' as anchor
  from lineitem join nodes n on n.ord = l_partkey join of using (id)),
conv as (
  select anchor, typed.type as consumer, count(*) as adoption, total, count(*)::double / total as coverage
  from typed join tot on tot.type = typed.type group by 1, 2, 4 having coverage >= 0.6)"""


def _anchored(spark, sf_dir):
    """Each part imports a shared file for each flag and line number that its lines have."""
    nodes = kept(star.parts(spark, sf_dir))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linenumber").repartition("l_partkey")
    lines = lines.select(F.col("l_partkey").alias("ord"), F.concat(F.lit("shared/"), "l_returnflag", F.col("l_linenumber").cast("string"), F.lit(".ts")).alias("dst")).distinct()
    return nodes, lines.join(grows(nodes.select("ord", F.col("id").alias("src"), F.when(F.col("type") == "test", "tests").otherwise("imports").alias("type"))), "ord")


@query(f"with {_CONV} select anchor, consumer, adoption, total, coverage from conv")
def conventions(spark, sf_dir):
    nodes, edges = _anchored(spark, sf_dir)
    return M.conventions(nodes, edges)


@query(f"""with {_CONV}
select anchor, consumer, of.id from conv join of on of.type = consumer where coverage >= 0.7 and not exists (select 1 from typed t where t.id = of.id and t.anchor = conv.anchor)""")
def convention_violations(spark, sf_dir):
    nodes, edges = _anchored(spark, sf_dir)
    return M.violators(nodes, edges, M.conventions(nodes, edges))


# --- history

_COMMITS = """
files as (select l_orderkey as c, o_orderdate as d, 'src/' || l_partkey || '.ts' as path, l_quantity::bigint as added, l_linenumber::bigint as removed from lineitem join orders on o_orderkey = l_orderkey)"""


@query(f"""with {_COMMITS},
per as (select path, c, max(d) as d, sum(added) as added, sum(removed) as removed from files where d >= (select max(d) from files) - interval 30 days group by 1, 2)
select path, count(*) as commits, sum(added)::bigint as added, sum(removed)::bigint as removed, arg_max(c, (d, c)) as last_commit, max(d) as last_date, 'order ' || arg_max(c, (d, c)) as last_message from per group by 1""")
def churn_30d(spark, sf_dir):
    return H.churn(star.commits(spark, sf_dir)).withColumn("last_message", F.regexp_extract("last_message", r"^order \d+", 0))


@query(f"""with {_COMMITS},
per as (select path, c, max(d) as d, sum(added) as added, sum(removed) as removed from files where d >= (select max(d) from files) - interval 30 days group by 1, 2)
select path, count(*) as commits, sum(added)::bigint as added from per group by 1 order by 2 desc, 1 limit 10""")
def churn_top(spark, sf_dir):
    return H.churn(star.commits(spark, sf_dir)).select("path", "commits", "added").orderBy(F.desc("commits"), "path").limit(10)


_PAIRS = """
f as (select distinct l_orderkey as c, 'src/' || l_suppkey || '.ts' as path from lineitem),
ok as (select c from f group by 1 having count(*) between 2 and 20),
g as (select * from f join ok using (c)),
tot as (select path, count(*) as n from g group by 1),
pair as (select x.path as a, y.path as b, count(*) as together from g x join g y on x.c = y.c and x.path < y.path group by 1, 2 having count(*) >= 3),
linked as (select distinct least(s, t) as a, greatest(s, t) as b from (select 'src/' || l_suppkey || '.ts' as s, 'src/' || (l_partkey % 1000) || '.ts' as t from lineitem)),
out as (
  select pair.a, pair.b, together, ta.n as total_a, tb.n as total_b, together::double / least(ta.n, tb.n) as confidence, linked.a is not null as linked
  from pair join tot ta on ta.path = pair.a join tot tb on tb.path = pair.b left join linked on linked.a = pair.a and linked.b = pair.b)"""


def _pairs(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("src/"), c.cast("string"), F.lit(".ts"))
    links = lines.select(name(F.col("l_suppkey")).alias("src"), name(F.col("l_partkey") % 1000).alias("dst"))
    return H.cochange(star.commits(spark, sf_dir, "l_suppkey"), links)


@query(f"with {_PAIRS} select * from out")
def cochange_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"with {_PAIRS} select a, b, together, confidence from out order by linked, confidence * together desc, a, b limit 8")
def cochange_top(spark, sf_dir):
    return H.top_pairs(_pairs(spark, sf_dir)).select("a", "b", "together", "confidence")


def _log(spark, sf_dir):
    """A numstat log for each customer: an order is a header, its lines follow."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    head = o.select(F.col("o_custkey").alias("repo"), (F.col("o_orderkey") * 100).alias("pos"), F.format_string("%07d|%s|order %d", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey").alias("line"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    body = li.withColumn("n", n).join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("repo"), (F.col("l_orderkey") * 100 + F.col("n")).alias("pos"), F.format_string("%d\t%d\tsrc/%d.ts", F.col("l_quantity").cast("long"), "l_linenumber", "l_partkey").alias("line"))
    return head.unionByName(body)


@query("""select o_custkey as repo, lpad(o_orderkey::varchar, 7, '0') as hash, strftime(o_orderdate, '%Y-%m-%d') as date, l_quantity::bigint as added, l_linenumber::bigint as removed, 'src/' || l_partkey || '.ts' as path
from lineitem join orders on o_orderkey = l_orderkey""")
def git_log_forward_fill(spark, sf_dir):
    return H.log_rows(_log(spark, sf_dir)).select("repo", "hash", "date", "added", "removed", "path")


# --- paths and texts


@query(r"""select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host, list_aggregate(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: x), 'string_agg', ' ') as links from pages""")
def extract_links(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.when(F.size(found) > 0, F.array_join(found, " ")).alias("links"))


_URL = "regexp_replace(coalesce(url, ''), '^[a-z]+://', '')"


@query(f"""with u as (select page_id, {_URL} as p, string_split({_URL}, '/') as s from pages)
select page_id, case when len(s) > 2 then s[1] || '/' || s[2] else s[1] end as module,
       case when len(s) >= 2 then s[len(s) - 1] || '/' || s[len(s)] else p end as tail,
       {_CAT.format("p || ' ' || p").replace('$', '$')} as category from u""")
def path_modules(spark, sf_dir):
    p = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", C.module_id(p).alias("module"), C.last_two(p).alias("tail"), C.edge_category(p, p).alias("category"))


@query(f"""with {NODES} select ord, case when regexp_matches(id, '\\.(test|spec|e2e-spec|e2e)\\.(ts|tsx|js|jsx)$|__tests__/|(^|/)(playwright|cypress|test|tests|e2e)/') then 'test'
  when regexp_matches(id, '/api/.*route\\.(ts|js)$') then 'api-route' else 'utility' end as kind, string_split(id, '/')[2] as domain from nodes""")
def path_classify(spark, sf_dir):
    content = F.col("p_name")
    n = star.parts(spark, sf_dir)
    meta = X.metadata(F.col("id"), content, F.lit("react"))
    return n.select("ord", C.file_type(F.col("id"), content).alias("kind"), X.domain_of(F.col("id"), content, meta).alias("domain"))


@query(f"""with {NODES}
select ord, case when ord % 3 <> 2 then id end as node from nodes""")
def resolve_relative(spark, sf_dir):
    """Specifiers that go up and down again; for each third one, to a file that isn't there."""
    n = star.parts(spark, sf_dir)
    base = F.regexp_replace("id", r"\.ts\z", "")
    spec = F.concat(F.lit("../../x/./../"), F.when(F.col("ord") % 3 == 2, F.lit("no/")).otherwise(""), base)
    wanted = n.select(F.col("ord").alias("key"), C.joined_path(C.folder(F.col("id")), spec).alias("path"))
    return R.find_nodes(wanted, n).select(F.col("key").alias("ord"), "node")


@query(f"""with {NODES} select ord, string_split(id, '/')[1] || '/' || string_split(id, '/')[2] as package, string_split(id, '/')[3] as rest from nodes""")
def resolve_longest_prefix(spark, sf_dir):
    n = star.parts(spark, sf_dir)
    names = n.select(C.module_id(F.col("id")).alias("name")).union(n.select(F.element_at(F.split("id", "/"), 1))).distinct().withColumn("dir", F.col("name"))
    return R.by_package(n.select(F.col("ord").alias("key"), F.col("id").alias("spec")), names).select(F.col("key").alias("ord"), "package", "rest")


@query(f"""with {NODES},
q as (select distinct string_split(id, '/')[3] as input from nodes union select distinct p_name from nodes)
select input, min(id) as id, case when count(id) = 1 then 'suffix' when count(id) > 1 then 'ambiguous' else 'unknown' end as status
from q left join nodes on ends_with(id, '/' || input) group by 1""")
def suffix_lookup(spark, sf_dir):
    n = star.parts(spark, sf_dir)
    asked = n.select(F.element_at(F.split("id", "/"), 3).alias("input")).union(n.select("p_name")).distinct()
    return R.by_suffix(asked, n.select("id")).select("input", "id", "status")


def _plans(spark, sf_dir):
    """A plan for each brand: a step for each part."""
    n = star.parts(spark, sf_dir)
    brand = F.element_at(F.split("id", "/"), 1)
    verb = F.when(F.col("ord") % 3 == 0, "Create: ").when(F.col("ord") % 3 == 1, "Modify: ").otherwise("Test: ")
    mark = F.when(F.col("ord") % 5 == 0, " [CHECKPOINT]").otherwise("")
    text = F.concat(F.lit("### Step "), F.col("ord").cast("string"), mark, F.lit("\n- "), verb, F.lit("`src/"), "id", F.lit(":"), F.col("lines").cast("string"), F.lit("`\n"))
    return n.groupBy(brand.alias("plan")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda x: x["t"]), "").alias("text"))


@query(f"with {NODES} select distinct string_split(id, '/')[1] as plan, 'src/' || id as path, true as known from nodes")
def plan_paths(spark, sf_dir):
    n = star.parts(spark, sf_dir).select(F.concat(F.lit("src/"), "id").alias("id"))
    return P.against_graph(P.named_files(_plans(spark, sf_dir)), n)


@query(f"""with {NODES},
s as (select string_split(id, '/')[1] as plan, ord, row_number() over (partition by string_split(id, '/')[1] order by ord) as step from nodes),
a as (select *, max(ord % 5 = 0) over (partition by plan order by step rows between 1 following and 2 following) as has from s)
select plan, step::bigint as step, 'Step ' || ord || case when ord % 5 = 0 then ' [CHECKPOINT]' else '' end as heading from a where ord % 3 = 0 and not coalesce(has, false)""")
def plan_checkpoints(spark, sf_dir):
    return P.missing_checkpoints(_plans(spark, sf_dir)).select("plan", "step", "heading")


# --- experiments


def _trials(spark, sf_dir):
    return star.trials(spark, sf_dir)


@query(f"""with {TRIALS},
a as (select condition, avg(score) as mean, coalesce(stddev_pop(score), 0) as deviation, min(score) as least, max(score) as most from scores group by 1),
b as (select condition, avg((verdict = 'PASS')::int) as passed, avg((verdict = 'PARTIAL')::int) as partial, avg((verdict = 'FAIL')::int) as failed, avg(latency) as latency, avg(tokens_in + tokens_out) as tokens from trials group by 1)
select * from a join b using (condition)""")
def condition_stats(spark, sf_dir):
    return E.condition_stats(_trials(spark, sf_dir))


@query(f"""with {TRIALS} select assertion, avg(s) filter (condition = 'click') as click, avg(s) filter (condition = 'error') as error, avg(s) filter (condition = 'purchase') as purchase,
avg(s) filter (condition = 'signup') as signup, avg(s) filter (condition = 'view') as view from trials group by 1""")
def task_pivot(spark, sf_dir):
    return E.by_task(_trials(spark, sf_dir), ["click", "error", "purchase", "signup", "view"], "assertion")


@query(f"""with {TRIALS},
d as (select a, b, avg(sign(x.score - y.score)) as delta from pairs join scores x on x.condition = a join scores y on y.condition = b group by 1, 2)
select *, case when abs(delta) < 0.147 then 'negligible' when abs(delta) < 0.33 then 'small' when abs(delta) < 0.474 then 'medium' else 'large' end as magnitude from d""")
def cliffs_delta(spark, sf_dir):
    return E.cliffs_delta(E.question_scores(_trials(spark, sf_dir)))


@query(f"""with {TRIALS},
placed as (select *, row_number() over (partition by condition order by ord, question) as place from scores),
gaps as (select a, b, x.score - y.score as g from pairs join placed x on x.condition = a join placed y on y.condition = b and y.place = x.place)
select a, b, count(*) filter (abs(g) >= 0.01 and g > 0) as wins, count(*) filter (abs(g) >= 0.01 and g < 0) as losses, count(*) filter (abs(g) < 0.01) as ties, count(*) as total
from gaps group by 1, 2""")
def win_rate(spark, sf_dir):
    return E.win_rates(E.question_scores(_trials(spark, sf_dir)))


@query(f"""with {TRIALS},
placed as (select condition, score, row_number() over (partition by condition order by ord, codebase, question) as place, count(*) over (partition by condition) as n from scores),
sizes as (select distinct condition, n from placed),
sides as (select a, b, 'a' as side, a as condition, n from pairs join sizes on condition = a union all select a, b, 'b', b, n from pairs join sizes on condition = b),
draws as (select *, unnest(range(1, n + 1)) as draw from (select *, unnest(range(0, 1000)) as i from sides)),
picks as (select a, b, i, side, condition, ('0x' || substr(md5(a || '|' || b || '|' || i || '|' || side || '|' || draw), 1, 8))::bigint % n + 1 as place from draws),
counted as (select a, b, i, score, count(*) filter (side = 'a') as na, count(*) filter (side = 'b') as nb from picks join placed using (condition, place) group by all),
below as (select *, coalesce(sum(nb) over (partition by a, b, i order by score rows between unbounded preceding and 1 preceding), 0) as lower, sum(nb) over (partition by a, b, i) as total from counted),
deltas as (select a, b, i, sum(na * (lower - (total - lower - nb)))::double / (sum(na) * max(total))::double as delta from below group by 1, 2, 3),
ranked as (select *, row_number() over (partition by a, b order by delta, i) - 1 as k from deltas)
select a, b, floor(max(delta) filter (k = 25) * 100 + 0.5) / 100 as lo, floor(max(delta) filter (k = 975) * 100 + 0.5) / 100 as hi from ranked group by 1, 2""")
def bootstrap_ci(spark, sf_dir):
    return E.bootstrap(E.question_scores(_trials(spark, sf_dir)))


def _rates(spark, sf_dir):
    return E.assertion_rates(_trials(spark, sf_dir))


_TELLS_NOTHING = "select codebase, question, assertion, count(*) as conditions, max(passed) - min(passed) as spread, avg(passed) as passed from rates group by 1, 2, 3 having count(*) >= 2 and max(passed) - min(passed) < 0.05"


@query(f"with {TRIALS} {_TELLS_NOTHING}")
def diag_non_discriminating(spark, sf_dir):
    return E.non_discriminating(_rates(spark, sf_dir))


_FLAKY = "select codebase, question, assertion, arg_min(condition, seen) as condition, arg_min(cv, seen) as cv, arg_min(verdicts, seen) as verdicts from rates where n >= 3 and cv > 0.3 group by 1, 2, 3"


@query(f"with {TRIALS} select * exclude verdicts from ({_FLAKY})")
def diag_flaky(spark, sf_dir):
    return E.flaky(_rates(spark, sf_dir))


_NEGATIVE = """per as (select codebase, question, condition_name as name, avg(s) as score from trials group by 1, 2, 3),
negative as (
  select codebase, question, w.name as worse, b.name as better, w.score as worse_score, b.score as better_score from per w join per b using (codebase, question)
  where lower(w.name) like '%full%' and lower(b.name) not like '%full%' and b.score - w.score > 0.05)"""


@query(f"with {TRIALS}, {_NEGATIVE} select * from negative")
def diag_negative(spark, sf_dir):
    return E.negative(_trials(spark, sf_dir))


#: Verdicts of an assertion in one list; ranks by counting smaller and equal ones of the cut list.
_RHO = f"""{TRIALS},
seq as (
  select codebase, question, assertion, list(s order by condition || ',', trial) as v,
         row_number() over (partition by codebase, question order by min((seen, ord)), assertion) - 1 as place
  from (select t.*, r.seen, r.ord from trials t join rates r using (codebase, question, assertion, condition)) group by 1, 2, 3),
cut as (
  select x.codebase, x.question, x.assertion as x, y.assertion as y, x.place as i, y.place as j, x.v[1:least(len(x.v), len(y.v))] as a, y.v[1:least(len(x.v), len(y.v))] as b
  from seq x join seq y on x.codebase = y.codebase and x.question = y.question and x.place < y.place),
ranked as (
  select *, list_transform(a, lambda p: len(list_filter(a, lambda q: q < p)) + (len(list_filter(a, lambda q: q = p)) + 1) / 2) as ra,
         list_transform(b, lambda p: len(list_filter(b, lambda q: q < p)) + (len(list_filter(b, lambda q: q = p)) + 1) / 2) as rb from cut),
rho as (
  select codebase, question, x, y, i::int as i, j::int as j,
         case when len(a) < 3 then 0 else 1 - 6 * list_sum(list_transform(list_zip(ra, rb), lambda p: (p[1] - p[2]) ** 2)) / (len(a)::double * (len(a)::double * len(a) - 1)) end as rho from ranked)"""


@query(f"with {_RHO} select * from rho")
def diag_correlation(spark, sf_dir):
    return E.correlations(_rates(spark, sf_dir))


#: A result has three assertions at most, so the walk over pairs in the order seen is three steps.
_REDUNDANT = f"""{_RHO},
hi as (
  select codebase, question, coalesce(bool_or(i = 0 and j = 1), false) as a, coalesce(bool_or(i = 0 and j = 2), false) as b, coalesce(bool_or(i = 1 and j = 2), false) as c
  from rho where abs(rho) > 0.9 group by 1, 2),
walk as (
  select codebase, question, 0 as i, 1 as j from hi where a
  union all select codebase, question, case when b then 0 else 1 end, 2 from hi where b or (c and not a)),
redundant as (select codebase, question, y as assertion, x as like_, rho from rho join walk using (codebase, question, i, j))"""


@query(f"with {_REDUNDANT} select codebase, question, assertion, like_ as like, rho from redundant")
def diag_redundant(spark, sf_dir):
    return E.redundant(E.correlations(_rates(spark, sf_dir)))


@query(f"with {TRIALS} select condition, avg(tools) as mean_tools, avg((tools = 0)::int) as none, count(*) as trials from trials where tools is not null group by 1")
def tool_usage(spark, sf_dir):
    return E.tool_usage(_trials(spark, sf_dir))


@query(f"""with {_REDUNDANT},
k as (
  select (select count(*) from ({_TELLS_NOTHING})) as w, (select count(*) from redundant) as r, (select count(*) from (select distinct question, assertion from trials)) as n,
         (select sum(tokens_in) / 1e6 * 3.0 + sum(tokens_out) / 1e6 * 15.0 from trials) as cost)
select floor(w / n * cost * 100 + 0.5) / 100 as wasted_on_non_discriminating, floor(r / n * cost * 100 + 0.5) / 100 as recoverable_from_redundant, floor((w / n * cost + r / n * cost) / cost * 100 + 0.5)::bigint as savings_percent from k""")
def budget(spark, sf_dir):
    t = settled(_trials(spark, sf_dir))
    return E.budget(t, E.diagnostics(t), E.summary(t))


@query(f"""with {TRIALS},
c as (select condition, avg((k = 1)::int) as consistent from (select condition, count(distinct verdict) as k from trials group by condition, question, assertion) group by 1)
select c.condition, consistent, partial, partial < 0.05 as biased from c join (select condition, avg((verdict = 'PARTIAL')::int) as partial from trials group by 1) p on p.condition = c.condition""")
def judge_consistency(spark, sf_dir):
    return E.consistency(_trials(spark, sf_dir))


@query(f"with {TRIALS} select condition, question, count(*) as n from trials group by 1, 2 having count(*) >= 3 and count(distinct verdict) = 1")
def early_stop(spark, sf_dir):
    return E.early_stop(_trials(spark, sf_dir))


#: Of a question's results on both codebases the last one counts.
_HALVES = """h as (
  select condition, question, arg_max(score, ord) filter (not late) as before, arg_max(score, ord) filter (late) as after
  from (select condition, question, codebase, ts >= timestamp '2024-01-16' as late, avg(s) as score, min(trial) as ord from trials group by 1, 2, 3, 4) group by 1, 2)"""


@query(f"""with {TRIALS},
{_HALVES},
d as (select *, after - before as delta from h where before is not null and after is not null)
select *, case when delta < -0.1 then 'regression' when delta > 0.1 then 'improvement' else 'same' end as change from d""")
def compare_iterations(spark, sf_dir):
    t = _trials(spark, sf_dir)
    cut = F.to_timestamp(F.lit("2024-01-16"))
    return E.compare(E.last_scores(t.where(F.col("ts") < cut)), E.last_scores(t.where(F.col("ts") >= cut)))


@query("""select event_id, case when value >= 60 then 'FAIL' when event_id % 4 = 3 then 'FAIL' when value < 30 then 'PASS' else 'PARTIAL' end as verdict from events""")
def score_responses(spark, sf_dir):
    """A judge's reply for each event; each fourth has no line for its assertion, which fails it."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("value") < 30, "pass").when(F.col("value") < 60, "Partial").otherwise("FAIL")
    number = F.when(F.col("event_id") % 4 == 3, "9").otherwise("2")
    lines = F.split(F.concat(F.lit("Verdicts:\nASSERTION_1: PASS - first\nassertion_"), number, F.lit(" : "), said, F.lit(" — so it is\n")), "\n")
    return e.select("event_id", X.verdict_line(lines, F.lit(2))["verdict"].alias("verdict"))


# --- layout

_BOXES = f"""{COMPLEX},
entry as (select distinct dst from edges where {MOD.format("src")} <> {MOD.format("dst")}),
sized as (select {MOD.format("id")} as module, count(*) as files, sum(lines)::bigint as lines from nodes group by 1),
m as (
  select module, row_number() over (order by lines desc, module) as i, count(*) over () as n,
         greatest(ceil(sqrt(files)) * {R.CELL} + 40, {R.LEAST_WIDTH})::double as width, greatest(ceil(files / ceil(sqrt(files))) * {R.CELL} + 60, {R.LEAST_HEIGHT})::double as height from sized),
fold(i, module, x, y, width, height, row, col) as (
  select i, module, 40.0::double, {R.TOP}::double, width, height, height, 1 from m where i = 1
  union all
  select m.i, m.module, case when w then 40.0 else nx end, case when w then f.y + f.row + {R.ROW_GAP} else f.y end, m.width, m.height,
         greatest(case when w then 0 else f.row end, m.height), case when w then 0 else f.col end + 1
  from fold f join m on m.i = f.i + 1, lateral (select f.x + f.width + {R.COLUMN_GAP} as nx), lateral (select f.col >= ceil(sqrt(m.n)) and nx + m.width > {R.WRAP_AT} as w)),
boxes as (select module, x, y, width, height from fold)"""


@query(f"with recursive {_BOXES} select * from boxes")
def layout_grid(spark, sf_dir):
    return R.grid(M.modules(*_graph(spark, sf_dir)))


def _turned(rows, edges, boxes):
    """rows of _complex() in their modules' boxes."""
    rows = rows.join(M.entry_points(edges).withColumn("entry", F.lit(True)), "id", "left").withColumn("entry", F.coalesce("entry", F.lit(False))).withColumn("module", C.module_id(F.col("id")))
    return R.spiral(rows, boxes)


def _placed(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return _turned(_complex(nodes, edges), edges, R.grid(M.modules(nodes, edges))), edges


_COLOUR = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in render.TYPE_COLOURS.items()) + f" else '{render.TYPE_COLOURS['utility']}' end"
_SPIRAL = f"""{_BOXES},
turn as (
  select cx.id, cx.type, {MOD.format("id")} as module, complexity, row_number() over (partition by {MOD.format("id")} order by (entry.dst is not null) desc, complexity desc, ord) - 1 as i,
         count(*) over (partition by {MOD.format("id")}) as n from cx left join entry on entry.dst = id),
spiral as (
  select id, module, x + width / 2 + r * cos(a) as x, y + height / 2 + {R.TITLE_SHIFT} + r * sin(a) as y, 4 + 14 * least(complexity, 1) as radius, {_COLOUR} as colour
  from (select t.*, b.x, b.y, b.width, b.height, i * (2 * pi() / n) * {R.GOLDEN} as a, case when n = 1 then 0 else (least(width, height) / 2 - {R.MARGIN}) * sqrt(i + 1) / sqrt(n) end as r from turn t join boxes b using (module)))"""


@query(f"with recursive {_SPIRAL} select id, module, round(x, 6) as x, round(y, 6) as y, round(radius, 6) as radius, colour from spiral")
def layout_spiral(spark, sf_dir):
    """Places to six decimals: cosines differ in the last bit."""
    six = lambda c: F.round(c, 6).alias(c)
    return _placed(spark, sf_dir)[0].select("id", "module", six("x"), six("y"), six("radius"), "colour")


@query(f"with recursive {_SPIRAL} select src, dst, count(*) as n from edges e join spiral s on s.id = src join spiral d on d.id = dst where round(sqrt((d.x - s.x) ** 2 + (d.y - s.y) ** 2), 6) >= 20 group by 1, 2")
def layout_links(spark, sf_dir):
    placed, edges = _placed(spark, sf_dir)
    return R.drawn_links(edges, placed, 20 - 5e-7).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with recursive {_BOXES}
select {MOD.format("src")} as from_module, {MOD.format("dst")} as to_module, count(*) as n, floor(a.x + a.width / 2 + 0.5)::bigint as x1, floor(a.y + a.height / 2 + 0.5)::bigint as y1, floor(b.x + b.width / 2 + 0.5)::bigint as x2, floor(b.y + b.height / 2 + 0.5)::bigint as y2
from edges join boxes a on a.module = {MOD.format("src")} join boxes b on b.module = {MOD.format("dst")} where a.module <> b.module group by 1, 2, 4, 5, 6, 7""")
def layout_roads(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    pairs = M.coupling(edges).groupBy("from_module", "to_module").agg(F.sum("n").alias("n"))
    return R.module_links(pairs, R.grid(M.modules(nodes, edges)))


@query(f"with {TRIALS} select * exclude s from trials order by md5(trial || '|' || assertion), trial, assertion limit 5")
def judge_sample(spark, sf_dir):
    """Five trials by chance: sampling is what it is for."""
    return E.sampled(_trials(spark, sf_dir), 5)
