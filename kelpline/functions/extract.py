"""What is read out of source texts, plans and judges' replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists.
IMPORT = r"""(?:import\s+[\s\S]*?from\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\))"""
EXPORT = r"export\s+(?:default\s+)?(?:function|const|class|type|interface|enum)\s+(\w+)"
MODEL = r"model\s+(\w+)\s*\{"
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")
BUCKETS = ("components", "hooks", "pages", "views", "layouts", "features", "modules")
PLAN_PATH = r"(?:src|prisma|docs|scripts|public|app|lib|components)/[\w./-]+\.(?:ts|tsx|js|jsx|json|prisma|css|md)"
ARCHITECTURE = (
    r"(?i)\bCreate:\s*`",
    r"(?i)\bcreate\b.*\b(?:new file|module)\b",
    r"(?i)\bSplit\b.*\binto\b",
    r"(?i)\bDelete\b.*`[^`]+`",
    r"(?i)\bRemove\b.*`[^`]+`",
    r"(?i)\bMerge\b.*\binto\b",
    r"(?i)\bMove\b.*\bto\b",
)
FRAMEWORKS = (("next", "nextjs"), ("@nestjs/core", "nestjs"), ("express", "express"), ("react", "react"), ("vue", "vue"), ("svelte", "svelte"))


def imports(content: Column) -> Column:
    """Specifiers in the order of the text."""
    found = F.zip_with(F.regexp_extract_all(content, F.lit(IMPORT), F.lit(1)), F.regexp_extract_all(content, F.lit(IMPORT), F.lit(2)), lambda a, b: F.when(a != "", a).otherwise(b))
    return F.filter(found, lambda x: ~x.startswith("node_modules"))


def exports(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(EXPORT), F.lit(1))


def framework_of(package_json: Column) -> Column:
    """The framework that a package.json names; typescript for one with none of them, unknown for null."""
    deps = F.from_json(package_json, "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.concat(*[F.coalesce(F.map_keys(deps[k]), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])
    out = F.lit("typescript")
    for key, name in reversed(FRAMEWORKS):
        out = F.when(F.array_contains(keys, key), name).otherwise(out)
    return F.when(package_json.isNull(), "unknown").otherwise(out)


def metadata(path: Column, content: Column, framework: Column) -> Column:
    """struct(type, methods, routePath, isClientComponent, isRootLayout, models); null where nothing is known."""
    kind = "struct<type: string, methods: array<string>, routePath: string, isClientComponent: boolean, isRootLayout: boolean, models: array<string>>"
    methods = F.filter(F.array(*map(F.lit, METHODS)), lambda m: F.regexp_like(content, F.concat(F.lit(r"export\s+(?:async\s+)?function\s+"), m)))
    client = content.contains("'use client'") | content.contains('"use client"')
    route = lambda tail: F.regexp_replace(F.regexp_replace(path, r"^src/app", ""), tail, "")
    none = F.lit(None)

    def made(type_: str, methods=none, route=none, client=none, root=none, models=none) -> Column:
        return F.struct(F.lit(type_).alias("type"), methods.alias("methods"), route.alias("routePath"), client.alias("isClientComponent"), root.alias("isRootLayout"), models.alias("models")).cast(kind)

    page = route(r"/page\.(tsx|jsx|ts|js)\z")
    next_js = (
        F.when(path.rlike(r"/api/.*route\.(ts|js)\z"), made("nextjs-api", methods=methods, route=route(r"/route\.(ts|js)\z")))
        .when(path.rlike(r"/page\.(tsx|jsx|ts|js)\z"), made("nextjs-page", route=F.when(page == "", "/").otherwise(page), client=client))
        .when(path.rlike(r"/layout\.(tsx|jsx|ts|js)\z"), made("nextjs-layout", root=path.contains("app/layout")))
        .when(client, made("react-client-component"))
    )
    prisma = F.when(path.endswith(".prisma"), made("prisma-schema", models=F.regexp_extract_all(content, F.lit(MODEL), F.lit(1))))
    return F.coalesce(F.when(framework == "nextjs", next_js), prisma)


def domain_of(path: Column, content: Column, meta: Column) -> Column:
    """The business domain: a router's route, a page's route, a barrel file's folder, or the folder."""
    segment = lambda x: F.get(F.filter(F.split(x, "/", -1), lambda p: p != ""), 0)
    routed = segment(F.regexp_extract(content, r"""createFileRoute\s*\(\s*['"`]([^'"`]+)['"`]\s*\)""", 1))
    page = F.when(meta["type"].isin("nextjs-page", "nextjs-api"), segment(meta["routePath"]))
    page = F.nullif(F.replace(F.regexp_replace(page, r"\[.*\]", ""), F.lit("-"), F.lit("_")), F.lit(""))
    has_page = meta["type"].isin("nextjs-page", "nextjs-api") & segment(meta["routePath"]).isNotNull()
    parts = F.split(path, "/", -1)
    again = F.regexp_count(content, F.lit(r"""export\s+\{[^}]+\}\s+from\s+['"]"""))
    every = F.regexp_count(content, F.lit(r"(?m)^export\s"))
    barrel = path.rlike(r"/index\.(ts|tsx|js|jsx)\z") & (again > 2) & (every > 0) & (again / every > 0.5)
    place = F.when((F.size(parts) >= 4) & F.get(parts, 1).isin(*BUCKETS), F.get(parts, 2)).when(F.size(parts) > 2, F.get(parts, 1)).when(F.size(parts) == 2, F.get(parts, 0))
    return F.when(routed.isNotNull() & (routed != "_authenticated"), routed).when(F.coalesce(has_page, F.lit(False)), page).when(F.coalesce(barrel, F.lit(False)), F.get(parts, F.size(parts) - 2)).otherwise(place)


def plan_paths(markdown: Column) -> Column:
    """Paths that a plan names, in back quotes or plain, without line numbers; distinct and in order."""
    clean = lambda x: F.regexp_replace(x, r":\d+(-\d+)?\z", "")
    quoted = F.transform(F.regexp_extract_all(markdown, F.lit(r"`([^`]+)`"), F.lit(1)), lambda x: F.regexp_replace(clean(x), r"(?i)^(?:Modify|Create|Test|File):\s*", ""))
    plain = F.transform(F.regexp_extract_all(markdown, F.lit(PLAN_PATH), F.lit(0)), clean)
    return F.array_sort(F.array_union(F.filter(quoted, lambda x: x.rlike(PLAN_PATH)), plain))


def verdict_line(lines: Column, number: Column) -> Column:
    """The first line that gives assertion number's verdict, as struct(verdict, reasoning); FAIL if there is none."""
    pattern = F.concat(F.lit(r"(?i)ASSERTION_"), number.cast("string"), F.lit(r"\s*:\s*(PASS|PARTIAL|FAIL)\s*[—–-]\s*(.*)"))
    fit = F.get(F.filter(lines, lambda x: F.regexp_like(x, pattern)), 0)
    verdict = F.upper(F.regexp_substr(F.regexp_substr(fit, F.concat(F.lit(r"(?i)ASSERTION_"), number.cast("string"), F.lit(r"\s*:\s*(PASS|PARTIAL|FAIL)"))), F.lit(r"(?i)(PASS|PARTIAL|FAIL)\z")))
    said = F.trim(F.regexp_extract(fit, r"(?i)ASSERTION_\d+\s*:\s*(?:PASS|PARTIAL|FAIL)\s*[—–-]\s*(.*)", 1))
    return F.struct(F.coalesce(verdict, F.lit("FAIL")).alias("verdict"), F.coalesce(said, F.lit("no verdict in the reply")).alias("reasoning"))
