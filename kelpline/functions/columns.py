"""Column expressions over paths, numbers and pairs of paths; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that sort paths, the first that fits wins. \z is the very end of a string.
TEST_FILE = r"\.(test|spec|e2e-spec|e2e)\.(ts|tsx|js|jsx)\z|__tests__/|(^|/)(playwright|cypress|test|tests|e2e)/"
CONFIG_FILE = r"\.(config|rc)\.(ts|js|mjs|cjs)\z|^tsconfig\.json\z"
ENTRY_FILES = (
    (r"/api/.*route\.(ts|js)\z", "api-route"),
    (r"/page\.(tsx|jsx|ts|js)\z", "route"),
    (r"/layout\.(tsx|jsx|ts|js)\z", "layout"),
    (r"/(loading|error|not-found|template|default|global-error)\.(tsx|jsx|ts|js)\z", "route"),
    (r"middleware\.(ts|js)\z", "middleware"),
    (r"\.controller\.(ts|js)\z", "route"),
    (r"\.module\.(ts|js)\z", "config"),
    (r"\.guard\.(ts|js)\z", "middleware"),
    (r"\.interceptor\.(ts|js)\z", "middleware"),
    (r"\.pipe\.(ts|js)\z", "middleware"),
    (r"\.filter\.(ts|js)\z", "middleware"),
)
AUTH = r"auth|session|login|magic-link|trusted-device|verify"
EDGE_CATEGORIES = (
    (AUTH, "auth"),
    (r"payment|authorize|order|cart|price|tip", "payment"),
    (r"test|spec|__tests__", "test"),
    (r"component|page|layout|\.tsx\z", "rendering"),
)
FLOW_CATEGORIES = (
    (AUTH, "auth"),
    (r"payment|authorize|order|cart|price|tip", "payment"),
    (r"prisma|schema|queries|api/|lib/", "data"),
    (r"component|page|layout|\.tsx\z", "rendering"),
)
NODE_DOMAINS = (
    (AUTH, "auth"),
    (r"payment|authorize-net|order|cart|price|tip", "payment"),
    (r"\btest\b|\.spec\.|__tests__", "test"),
)


def first_fit(text: Column, rules, otherwise: str | Column) -> Column:
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return reduce(lambda rest, rule: F.when(text.rlike(rule[0]), rule[1]).otherwise(rest), reversed(rules), out)


def round2(x: Column) -> Column:
    """Two decimals, halves up on the binary value."""
    return F.floor(x * 100 + 0.5) / 100


def module_id(path: Column) -> Column:
    """The first two segments of a path of more than two, else the first."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) > 2, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.get(parts, 0))


def flow_module_id(path: Column) -> Column:
    """As module_id(), with three segments below src/lib, src/app and src/components."""
    parts = F.split(path, "/", -1)
    deep = (F.size(parts) > 3) & (F.get(parts, 0) == "src") & F.get(parts, 1).isin("lib", "app", "components")
    return F.when(deep, F.concat_ws("/", F.slice(parts, 1, 3))).otherwise(module_id(path))


def file_type(path: Column, content: Column) -> Column:
    exports = content.contains("export default function") | content.contains("export function") | content.contains("export const")
    tail = F.when(path.rlike(r"\.(tsx|jsx)\z") & exports, "component").otherwise("utility")
    rules = ((TEST_FILE, "test"), (CONFIG_FILE, "config"), (r"\.prisma\z", "schema"), *ENTRY_FILES)
    return first_fit(F.replace(path, F.lit("\\"), F.lit("/")), rules, tail)


def edge_category(src: Column, dst: Column) -> Column:
    return first_fit(F.concat_ws(" ", src, dst), EDGE_CATEGORIES, "data")


def flow_category(src: Column, dst: Column) -> Column:
    return first_fit(F.concat_ws(" ", src, dst), FLOW_CATEGORIES, "data")


def node_domain(path: Column) -> Column:
    return first_fit(path, NODE_DOMAINS, "other")


def short_path(path: Column) -> Column:
    """Without src/ before it, and without extension, /route and /page at its end."""
    out = F.regexp_replace(path, r"^src/", "")
    for tail in (r"\.(ts|tsx|js|jsx)\z", r"/route\z", r"/page\z"):
        out = F.regexp_replace(out, tail, "")
    return out


def last_two(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.slice(parts, -2, 2))).otherwise(path)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4 + 0.5)


def joined_path(base: Column, relative: Column) -> Column:
    """base/relative with . and .. taken out; a .. with nothing before it stays; a slash at the end stays."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/", -1), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    step = lambda acc, p: F.when((F.size(acc) > 0) & (p == "..") & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, p))
    whole = F.array_join(F.aggregate(parts, empty, step), "/")
    whole = F.when(whole == "", ".").otherwise(whole)
    return F.when(relative.endswith("/") & ~whole.endswith("/"), F.concat(whole, F.lit("/"))).otherwise(whole)


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(".")
