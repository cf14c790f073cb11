import datetime as dt
import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from kelpline.functions import columns as C
from kelpline.common import row_numbers
from kelpline.functions import extract as X
from kelpline.functions import render as Z
from kelpline.operators import graph as G
from kelpline.operators import history as H
from kelpline.operators import modules as M
from kelpline.operators import profile
from kelpline.operators import resolve as R
from kelpline.plans import check as P
from kelpline.plans import report, snapshot
from kelpline.sources import code_tree
from kelpline.streaming import churn as S


def lines(spark, text):
    return spark.createDataFrame([("r", i, x) for i, x in enumerate(text.split("\n"))], "repo string, pos long, line string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numstat_log(spark):
    log = lines(spark, "9f3e21c|2024-05-06|mend\n7\t3\tlib/q.ts\n-\t-\tlogo.gif\n\n77aa015|2024-05-04|start\n41\t0\tlib/q.ts\n6\t2\tr.ts")
    rows = H.log_rows(log).collect()
    assert {(r.hash, r.path, r.added) for r in rows} == {("9f3e21c", "lib/q.ts", 7), ("77aa015", "lib/q.ts", 41), ("77aa015", "r.ts", 6)}


def test_names_log(spark):
    log = lines(spark, "aaaaaaa\n\nx.ts\ny.ts\n\nlost.ts\nbbbbbbb\n\nz.ts")
    got = {(r.commit_seq, r.path) for r in H.log_files(log).collect()}
    assert got == {(1, "x.ts"), (1, "y.ts"), (2, "z.ts")}


def commits(spark, sets):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, day, p, 1, 1) for i, s in enumerate(sets) for p in s], "commit long, date timestamp, path string, added long, removed long")


def test_cochange(spark):
    """Random commits of 1 to 30 files against counting every pair."""
    rng = random.Random(12)
    made = [[f"f{k}" for k in rng.sample(range(40), rng.choice([1, 2, 3, 6, 20, 21, 30]))] for _ in range(150)]
    few = [set(c) for c in made if 2 <= len(c) <= 20]
    names = sorted({f for c in few for f in c})
    count = lambda *files: sum(set(files) <= c for c in few)
    want = {(x, y): (n, count(x), count(y)) for i, x in enumerate(names) for y in names[i + 1 :] if (n := count(x, y)) >= 4}
    links = spark.createDataFrame([("f9", "f8"), ("f1", "f7")], "src string, dst string")
    pairs = H.cochange(commits(spark, made), links, least=4).collect()
    assert {(r.a, r.b): (r.together, r.total_a, r.total_b) for r in pairs} == want and len(want) > 100
    assert all(r.linked == ({r.a, r.b} in ({"f9", "f8"}, {"f1", "f7"})) and r.confidence == r.together / min(r.total_a, r.total_b) for r in pairs)
    # What no import explains comes first.
    tight = H.cochange(commits(spark, [["p", "q"]] * 7 + [["q", "r"]] * 6), spark.createDataFrame([("q", "p")], "src string, dst string"))
    assert [(r.a, r.b, r.linked) for r in H.top_pairs(tight).collect()] == [("q", "r", False), ("p", "q", True)]


def test_churn_window(spark):
    rows = [(1, dt.datetime(2024, 3, 1), "last", "a", 1, 2), (2, dt.datetime(2024, 2, 20), "before", "a", 3, 4), (3, dt.datetime(2024, 1, 1), "old", "a", 9, 9)]
    got = H.churn(spark.createDataFrame(rows, "commit long, date timestamp, message string, path string, added long, removed long")).collect()
    assert [(r.commits, r.added, r.removed, r.last_commit, r.last_message) for r in got] == [(2, 4, 6, 1, "last")]


def test_row_numbers(spark):
    rows = [(g, i * 37 % 101) for g in "xy" for i in range(90)] + [(None, 5), ("x", 37)]
    got = row_numbers(spark.createDataFrame(rows, "g string, v long").repartition(5), ["g"], ["v"]).collect()
    for g in ("x", "y", None):
        mine = sorted((r.place, r.v) for r in got if r.g == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_rendering(spark):
    from decimal import ROUND_HALF_UP, Decimal

    xs = [i / 1000 for i in range(0, 3000, 7)] + [0.25, 1.15, 2.5, 1.005, 0.125, 9.995, 1e6 + 0.05]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[Z.fixed(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2)]).collect()
    for r in rows:
        for d in (0, 1, 2):
            assert r[f"d{d}"] == str(Decimal(r.x).quantize(Decimal(1).scaleb(-d), ROUND_HALF_UP))
    assert one(spark, Z.complexity_bar(F.lit(0.6))) == "███▓░░····"
    assert one(spark, Z.blended(F.lit("#000000"), F.lit("#FF0080"), F.lit(0.5))) == "rgb(128,0,64)"
    assert one(spark, Z.complexity_colour(F.lit(1.0))) == "rgb(230,57,70)" and one(spark, Z.glyph(F.lit("test"))) == "▲"
    assert one(spark, Z.xml_escaped(F.lit('<a b="&">'))) == "&lt;a b=&quot;&amp;&quot;&gt;"
    assert one(spark, Z.some(F.array(*map(F.lit, "abcd")), 2)) == "a, b, +2 more" and one(spark, Z.described(F.lit("x/lib"))) == "auth, payment, POS, email"
    assert one(spark, report.prompt(F.lit(""), F.lit("q?"), F.lit("Be brief."))) == "Be brief.\n\nq?"


def test_whole_reports(spark):
    nodes = spark.createDataFrame([(0, "lib/core.ts", "utility", 90, 0.5, 0, ["run", "default"], None, None, False), (1, "app/a.ts", "api-route", 30, 0.9, 1, [], ["GET"], "/api/a", False), (2, "app/b.ts", "api-route", 40, 0.9, 1, [], None, None, False), (3, "app/p.tsx", "route", 5, 0.1, 1, [], None, "/", True), (4, "ui/c.tsx", "component", 12, 0.35, 0, [], None, None, False)], "ord long, id string, type string, lines int, complexity double, n_imports long, exports array<string>, methods array<string>, route string, client boolean")
    edges = spark.createDataFrame([("app/a.ts", "lib/core.ts", "imports", 0), ("app/b.ts", "lib/core.ts", "imports", 1), ("app/p.tsx", "app/b.ts", "imports", 2)], "src string, dst string, type string, ord long")
    risk = G.blast_radius(nodes, edges)
    sections = [report.header(spark, "demo", "nextjs", report.totals(nodes), "2024-01-01T00:00:00"), report.risk_section(G.risk_tiers(risk, nodes), risk, nodes, M.inbound(edges)), report.flows_section(M.flows(nodes, edges), risk, nodes, edges), report.routes_section(nodes), report.pages_section(nodes)]
    whole = report.combined(sections)
    assert report.text(whole).splitlines() == [
        "KELPLINE v3 | demo | Nextjs | 5 files | 177 lines | generated 2024-01-01T00:00:00",
        report.LEGEND,
        report.USAGE,
        "",
        report.TITLES["risk"],
        "      amp1.5  ×2→3      d2   1mod  T0   lib/core.ts",
        "  cascades to: app",
        "  exports: run",
        "",
        report.TITLES["flows"],
        "Entry points and their cross-module dependencies",
        "",
        "data:       app/b -> lib/core",
        "            app/a -> lib/core",
        "",
        "─── API ROUTES (2) ─────────────────────────────────",
        f"{'?':<7}{'app/b.ts':<50}   40L 0.90",
        f"{'GET':<7}{'/api/a':<50}   30L 0.90",
        "",
        "─── PAGES (1) ──────────────────────────────────────────",
        f"{'/ [client]':<44}    5L 0.10",
        "",
    ]
    mods, cover = M.modules(nodes, edges), M.coverage(nodes, edges)
    first = report.text(report.first_format("demo", "nextjs", nodes, edges, mods, M.coupling(edges), M.most_imported(edges, nodes, with_tests=True), cover))
    assert "████▓▓▓··  " not in first and "GET                /api/a" in first and " ← payment+POS hub" in first and first.endswith("0 test files | 0/5 testable files with direct test edges (0.0%)\n")
    plain = report.plain_text("demo", "nextjs", nodes, mods, M.most_imported(edges, nodes, 10, with_tests=True), cover, risk)
    bare = report.plain_text("demo", "nextjs", nodes, mods, M.most_imported(edges, nodes, 10, with_tests=True), cover, risk, bare=True)
    text = report.text(plain)
    assert "- lib/core.ts: 3 affected, depth 2, 1 modules, amp 1.5\n" in text and "\n\n## Components (1)\n- c.tsx (12 lines, complexity: 0.35)\n" in text
    assert "Risk" not in report.text(bare) and "- c.tsx (12 lines)\n" in report.text(bare)
    assert not report.variant(whole, plain, bare, "v2").where("line like 'USAGE%'").count() and report.variant(whole, plain, bare, "none").count() == 0
    hubs = nodes.where("type <> 'api-route'")
    assert "FLOWS" not in report.text(report.combined([report.flows_section(M.flows(hubs, edges), risk, hubs, edges)]))


def test_extract(spark):
    text = "import a from './a';\nimport {\n b } from \"b\"\nconst c = require('c'); import x from 'node_modules/x'\nexport default function Foo() {}\nexport const bar = 1\nexport async function no() {}"
    assert one(spark, X.imports(F.lit(text))) == ["./a", "b", "c"]
    assert one(spark, X.exports(F.lit(text))) == ["Foo", "bar"]
    assert one(spark, X.framework_of(F.lit('{"devDependencies": {"react": "1"}, "dependencies": {"next": "1"}}'))) == "nextjs"
    meta = one(spark, X.metadata(F.lit("src/app/api/order/route.ts"), F.lit("export async function POST() {}"), F.lit("nextjs")))
    assert (meta.type, meta.methods, meta.routePath) == ("nextjs-api", ["POST"], "/api/order")


def test_classify(spark):
    cases = {"src/a.test.ts": "test", "e2e/x.ts": "test", "vite.config.ts": "config", "p/schema.prisma": "schema", "src/app/api/x/route.ts": "api-route", "src/app/page.tsx": "route", "src/app/layout.tsx": "layout", "src/x.guard.ts": "middleware", "src/x.service.ts": "utility", "src/B.tsx": "component"}
    df = spark.createDataFrame(list(cases.items()), "p string, want string").withColumn("got", C.file_type(F.col("p"), F.lit("export function B() {}")))
    assert df.where("got <> want").count() == 0


def test_paths(spark):
    join = lambda a, b: one(spark, C.joined_path(F.lit(a), F.lit(b)))
    assert [join("src/a", "../b"), join("src", "./x"), join("src", "../../x"), join("src/a", "."), join("src", "./")] == ["src/b", "src/x", "../x", "src/a", "src/"]
    assert one(spark, C.flow_module_id(F.lit("src/lib/x/y.ts"))) == "src/lib/x" and one(spark, C.round2(F.lit(0.285))) == 0.28


def test_resolution(spark):
    nodes = spark.createDataFrame([(0, "src/a.ts", "utility", ["./b", "@x/core", "@x/core/z", "@app/b", "react", "./b"]), (1, "src/b.tsx", "utility", []), (2, "packages/core/src/index.ts", "utility", []), (3, "packages/core/src/z.ts", "utility", [])], "ord long, id string, type string, imports array<string>")
    aliases = spark.createDataFrame([("@app", "src", 0)], "alias string, target string, ord int")
    packages = spark.createDataFrame([("@x/core", "packages/core", None)], "name string, dir string, entry string")
    got = [(r.src, r.dst) for r in R.imports_to_edges(nodes, aliases, packages).orderBy("ord").collect()]
    assert got == [("src/a.ts", x) for x in ("src/b.tsx", "packages/core/src/index.ts", "packages/core/src/z.ts", "src/b.tsx", "src/b.tsx")]


def test_suffix(spark):
    ids = spark.createDataFrame([("kiln/oven.ts",), ("kiln/left/dial.ts",), ("kiln/right/dial.ts",)], "id string")
    asked = spark.createDataFrame([("oven.ts",), ("\\kiln\\oven.ts",), ("dial.ts",), ("left/dial.ts",), ("ven.ts",)], "input string")
    got = {r.input: (r.id, r.status) for r in R.by_suffix(asked, ids).collect()}
    assert got == {"oven.ts": ("kiln/oven.ts", "suffix"), "\\kiln\\oven.ts": ("kiln/oven.ts", "exact"), "dial.ts": (None, "ambiguous"), "left/dial.ts": ("kiln/left/dial.ts", "suffix"), "ven.ts": (None, "unknown")}


def test_plans(spark):
    text = "# T\n### One\nCreate: `src/lib/x.ts:1-20` and src/app/y.tsx\n### Two\n### Three [CHECKPOINT]\n### Four\nSplit `src/lib/z.ts` into two"
    plans = spark.createDataFrame([("p", text)], "plan string, text string")
    assert [r.path for r in P.named_files(plans).collect()] == ["src/app/y.ts", "src/lib/x.ts", "src/lib/z.ts"]  # of plain paths, the pattern takes the first ending that fits
    assert [(r.step, r.files) for r in P.missing_checkpoints(plans).collect()] == [(4, ["src/lib/z.ts"])]


def test_judge_lines(spark):
    said = F.array(*map(F.lit, ["assertion_1: pass — good", "ASSERTION_2 : Partial - half"]))
    got = [one(spark, X.verdict_line(said, F.lit(i))["verdict"]) for i in (1, 2, 3)]
    assert got == ["PASS", "PARTIAL", "FAIL"]


def test_tree_snapshot_report(spark, tmp_path):
    for name, text in {"src/lib/a.ts": "export const a = 1", "src/app/b.ts": "import { a } from '../lib/a'\n", "src/app/c.test.ts": "import b from './b'", "node_modules/x/i.ts": "", "package-lock.json": "{}"}.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    nodes = code_tree.nodes_of(code_tree.read_files(spark, str(tmp_path / "tree")), '{"dependencies": {}}')
    assert [(r.id, r.type, r.lines) for r in nodes.orderBy("ord").collect()] == [("src/app/b.ts", "utility", 2), ("src/app/c.test.ts", "test", 1), ("src/lib/a.ts", "utility", 1)]
    edges = R.imports_to_edges(nodes, code_tree.aliases(spark, None), code_tree.packages(spark, str(tmp_path / "tree")))
    assert {(r.src, r.dst, r.type) for r in edges.collect()} == {("src/app/b.ts", "src/lib/a.ts", "imports"), ("src/app/c.test.ts", "src/app/b.ts", "tests")}
    snapshot.write(spark, str(tmp_path / "snap"), {"nodes": nodes, "edges": edges}, "h")
    back = snapshot.read(spark, str(tmp_path / "snap"))
    assert back["edges"].count() == 2 and snapshot.is_stale(spark, str(tmp_path / "snap"), "other")
    rows = report.combined([report.infrastructure_section(M.coupling(back["edges"])), report.churn_section(spark.createDataFrame([], "path string, commits long, added long, removed long, last_message string"), nodes)])
    assert report.text(rows).splitlines()[3:] == ["app          ·······╢ lib            × 1  data:1", ""] and "CHURN" not in report.text(rows)


def test_git_log(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init")
    (tmp_path / "a.ts").write_text("1\n2\n")
    git("add", ".")
    git("commit", "-m", "one")
    rows = H.log_rows(code_tree.git_log(spark, str(tmp_path))).collect()
    assert [(r.path, r.added, r.msg) for r in rows] == [("a.ts", 2, "one")]
    assert H.log_rows(code_tree.git_log(spark, "/nonexistent")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = commits(spark, ["ab", "ac"])
    late = spark.createDataFrame([(9, dt.datetime(2024, 6, 1), "z", 1, 1)], rows.schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.run_available(S.churn_windows(stream, "1 day", "30 days", "10 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in S.churn_windows(rows, length="30 days", slide="10 days").collect()}
    assert got == want


def test_workspaces(spark, tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("mono/package.json", "{broken")
    put("mono/pnpm-workspace.yaml", "# all\npackages:  # these\n  - 'libs/*'  # each\n  - \"!libs/old\"\nother:\n  - x/*\n")
    put("mono/libs/a/package.json", '{"name": "@m/a", "exports": {".": {"import": "./src/main.ts"}}}')
    put("mono/libs/old/package.json", '{"name": "@m/old"}')
    put("mono/libs/bad/package.json", "[1]")
    put("mono/libs/node_modules/z/package.json", '{"name": "z"}')
    put("mono/libs/a/src/main.ts", "export const a = 1")
    assert code_tree.workspace_globs("{broken", "packages:\n - 'x/*' # y") == ["x/*"]
    root, offset = code_tree.workspace_root(str(tmp_path / "mono/libs/a"))
    assert (root, offset) == (str(tmp_path / "mono"), "libs/a")
    found = code_tree.packages(spark, root)
    assert [tuple(r) for r in found.collect()] == [("@m/a", "libs/a", "src/main.ts")]
    assert [r.dir for r in code_tree.below_offset(found, "libs").collect()] == ["a"] and code_tree.below_offset(found, "apps").count() == 0
    assert code_tree.workspace_globs('{"workspaces": ["a/*"]}', "packages:\n  - b/*") == ["a/*"] and code_tree.workspace_globs("{}", "packages:\n  - b/*") == ["b/*"]
    (tmp_path / "alone/.git").mkdir(parents=True)
    assert code_tree.workspace_root(str(tmp_path / "alone")) == (str(tmp_path / "alone"), "") and code_tree.head_of(str(tmp_path / "alone")) is None
    files = code_tree.read_files(spark, str(tmp_path / "mono/libs/a"))
    assert code_tree.newest(files).first().modified == files.first().modified
    snapshot.write(spark, str(tmp_path / "mono/.kelpline"), {"packages": found})
    assert snapshot.find(root + "/libs/a") == root + "/.kelpline" and snapshot.find(str(tmp_path / "alone")) is None
    snapshot.write_text("x", str(tmp_path / "report"))
    assert (tmp_path / "report").read_text() == "x" and not (tmp_path / "report.tmp").exists()


def one_log(seed, n):
    """A name-only log's lines: headers, files, blank lines in odd places."""
    rng = random.Random(seed)
    return [rng.choice([f"{rng.randrange(16**8):08x}", "", " ", "src/a.ts", " src/b.ts ", "src/c.ts", f"src/{rng.randrange(9)}.ts"]) for _ in range(n)]


def read_log(lines):
    """commit, file: line by line."""
    out, seq, some, closed = set(), 0, False, False
    for line in lines:
        if re.fullmatch("[0-9a-f]{7,40}", line):
            seq, some, closed = seq + 1, False, False
        elif not line.strip():
            closed = closed or some
        elif seq:
            some = True
            if not closed:
                out.add((seq, line.strip()))
        else:
            some = True
    return out


def test_logs_in_ranges(spark):
    logs = {"one": one_log(1, 400), "two": one_log(2, 37), "none": ["", "x"], "heads": ["abcdef1"] * 3, "late": ["f"] * 60 + ["", "abcdef1", "g"]}
    rows = [(r, i, x) for r, lines in logs.items() for i, x in enumerate(lines)]
    random.Random(3).shuffle(rows)
    log = spark.createDataFrame(rows, "repo string, pos long, line string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "29"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {(r.repo, r.commit_seq, r.path) for r in H.log_files(log).collect()}
            assert got == {(repo, *x) for repo, lines in logs.items() for x in read_log(lines)}
        numstat = [("r", i, f"{i:07x}|2024-01-01|m{i}" if i % 7 == 3 else f"{i}\t1\tf{i}") for i in range(120)]
        rows = H.log_rows(spark.createDataFrame(numstat, "repo string, pos long, line string")).collect()
        assert {(r.pos, r.msg, r.added) for r in rows} == {(i, f"m{(i - 3) // 7 * 7 + 3}", i) for i in range(4, 120) if i % 7 != 3}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_snapshot_versions(spark, tmp_path):
    path = str(tmp_path / "snap")
    with pytest.raises(snapshot.SnapshotError, match="no snapshot"):
        snapshot.read(spark, path)
    rows = lambda k: spark.range(200).select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("node"), F.lit(k).alias("affected"))
    snapshot.write(spark, path, {"risk": rows(1), "other": rows(1)}, "h1")
    first = snapshot.read(spark, path)
    # Derived from the version before, which stays whole for who reads it.
    snapshot.write(spark, path, {"risk": first["risk"].withColumn("affected", F.lit(2)), "other": rows(2)}, "h2")
    second = snapshot.read(spark, path)
    for tables, k in ((first, 1), (second, 2)):
        assert all({r.affected for r in df.collect()} == {k} and df.count() == 200 for df in tables.values())
    assert snapshot.is_stale(spark, path, "h1") and not snapshot.is_stale(spark, path, "h2")
    one = second["risk"].where(F.col("node") == "f017")
    assert one.count() == 1 and "EqualTo(node,f017)" in one._jdf.queryExecution().executedPlan().toString()
    assert snapshot.prune(spark, path) == 1 and second["risk"].count() == 200
    (tmp_path / "snap" / snapshot.MANIFEST).write_text('{"version": 1}')
    (tmp_path / "snap" / f".{snapshot.MANIFEST}.crc").unlink(missing_ok=True)
    with pytest.raises(snapshot.SnapshotError, match="version 1"):
        snapshot.read(spark, path)
    (tmp_path / "snap" / snapshot.MANIFEST).write_text("{")
    with pytest.raises(snapshot.SnapshotError, match="broken"):
        snapshot.read(spark, path)


def test_point_queries(spark, tmp_path):
    names = ["a/x/core.ts", "b/y/mid.ts", "c/z/top.ts", "c/z/top.spec.ts", "d/alone.ts"]
    nodes = spark.createDataFrame([(n, "test" if ".spec." in n else "utility", 5, i) for i, n in enumerate(names)], "id string, type string, lines int, ord long")
    edges = spark.createDataFrame([(names[1], names[0], "imports", 0), (names[2], names[1], "imports", 1), (names[3], names[2], "tests", 2)], "src string, dst string, type string, ord long")
    snapshot.write(spark, str(tmp_path / "s"), snapshot.analysed(nodes, edges))
    tables = snapshot.read(spark, str(tmp_path / "s"))
    text = profile.blast_radius_text(snapshot.blast_radius(tables, names[0])).first().text
    assert text == "a/x/core.ts  ×1→2  d2  amp2  2mod\naffected modules: b/y, c/z\ncascade: mid.ts(d1) → top.ts(d2)"
    assert profile.blast_radius_text(snapshot.blast_radius(tables, names[4])).first().text == "d/alone.ts  ×0→0  d0  amp0  0mod"
    # What is stored is taken as it is.
    other = tables | {"risk": tables["risk"].withColumn("affected", F.lit(77))}
    assert snapshot.blast_radius(other, names[0]).first().affected == 77
    tests = snapshot.test_map(tables, names[0])
    assert profile.test_map_text(tests).first().text == "a/x/core.ts — 1 test files connected (structural, not runtime coverage)\ntransitive: c/z/top.spec.ts (via c/z/top.ts)"
    assert snapshot.test_map(tables, names[4]).first().n_tests == 0 and '"n_tests":1' in profile.as_json(tests).first().json


def test_staleness(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    for k in range(3):
        git("commit", "-q", "--allow-empty", "-m", f"m{k}")
    path, log = str(tmp_path / "s"), git("rev-list", "HEAD").split()
    said = {}
    for head in (log[0], log[2], "0" * 40, None):
        snapshot.write(spark, path, {"x": spark.range(1)}, head)
        said[head] = snapshot.staleness(spark, path, str(tmp_path))
    assert said[log[0]] is None and said[None] is None and "before 2 commits" in said[log[2]] and "may be stale" in said["0" * 40]
    assert snapshot.staleness(spark, path, str(tmp_path / "nowhere")) is None


def test_more_rows_have_more_tasks(spark):
    """Rows of a task stay about as many, however many there are: 4 shuffle partitions here."""
    from kelpline.common import in_ranges, spread, tasks_for

    assert (tasks_for(spark, 10, 100), tasks_for(spark, 950, 100)) == (4, 10)
    rows = spark.range(950).select(F.col("id").alias("pos"))
    dealt = in_ranges(rows, "pos", each=100)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.groupBy("_range").count().agg(F.max("count")).first()[0] < 300
    assert spread(rows, 10, "pos").distinct().rdd.getNumPartitions() == 10 and dealt.count() == 950


def test_pairs_of_files_are_counted_by_number(spark, monkeypatch):
    written, kept = [], H.kept
    monkeypatch.setattr(H, "kept", lambda df: written.append(df.schema) or kept(df))
    pairs = H.cochange(commits(spark, [["q", "p", "p"], ["p", "q"], ["p", "q", "r"]])).collect()
    assert [(r.a, r.b, r.together, r.total_a, r.total_b) for r in pairs] == [("p", "q", 3, 3, 3)]
    assert [s["a"].dataType.simpleString() for s in written if "a" in s.names] == ["bigint"]
