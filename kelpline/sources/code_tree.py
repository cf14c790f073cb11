"""A source tree and its git log as DataFrames."""

from __future__ import annotations

import json
import os
import re
import subprocess
from fnmatch import fnmatchcase
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import file_type
from ..functions.extract import domain_of, exports, framework_of, imports, metadata

# What a scan leaves out and what it takes.
IGNORED_FOLDERS = ("node_modules", ".next", ".git", "dist", ".claude", ".worktrees", ".vercel", "coverage", "__pycache__")
IGNORED_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".DS_Store", "thumbs.db")
SOURCE = r"\.(ts|tsx|js|jsx|mjs|cjs|prisma)\z"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), content, modified of the tree's source files."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    path = F.expr(f"substring(regexp_replace(_metadata.file_path, '^file:/*', '/'), {len(str(Path(root).resolve())) + 2})")
    rows = raw.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"), plain.alias("_p"))
    ignored = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED_FOLDERS))) | F.element_at(F.split("path", "/"), -1).isin(*IGNORED_FILES)
    return rows.where(F.col("path").rlike(SOURCE) & ~ignored).drop("_p")


def nodes_of(files: DataFrame, package_json: str | None) -> DataFrame:
    """files (path, content) as graph nodes; ord is the place by path."""
    framework = framework_of(F.lit(package_json).cast("string"))
    path, content = F.col("path"), F.col("content")
    meta = metadata(path, content, framework)
    rows = files.select(path.alias("id"), path, file_type(path, content).alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), F.size(F.split("content", "\n", -1)).alias("lines"), imports(content).alias("imports"), exports(content).alias("exports"), meta.alias("framework"), domain_of(path, content, meta).alias("domain"))
    # Sorted by ranges: the ids rise with the path, and no single task numbers all rows.
    return rows.withColumn("n_imports", F.size("imports")).orderBy("id").withColumn("ord", F.monotonically_increasing_id())


def aliases(spark: SparkSession, tsconfig: str | None) -> DataFrame:
    """alias, target, ord of a tsconfig.json's paths; none where it can't be read."""
    rows: list[tuple[str, str, int]] = []
    try:
        text = "\n".join(x for x in (tsconfig or "").splitlines() if not x.lstrip().startswith("//"))
        for i, (k, v) in enumerate((json.loads(text).get("compilerOptions", {}).get("paths") or {}).items()):
            if v:
                rows.append((k.removesuffix("/*"), v[0].removesuffix("/*").removeprefix("./"), i))
    except ValueError:
        pass
    return spark.createDataFrame(rows, "alias string, target string, ord int")


def _manifest(text: str | None) -> dict:
    """A package.json; one that can't be read, or is no object, is empty."""
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def workspace_globs(package_json: str | None, pnpm: str | None) -> list[str]:
    """Of package.json's workspaces, or where it has none of pnpm-workspace.yaml's packages, without comments."""
    found = _manifest(package_json).get("workspaces") or []
    found = found.get("packages") or [] if isinstance(found, dict) else list(found)
    if found:
        return found
    inside = False
    for line in (pnpm or "").splitlines():
        line = re.sub(r"(^|\s)#.*", "", line)
        if line.strip().startswith("packages:"):
            inside = True
        elif inside and line.strip().startswith("-"):
            found.append(line.strip()[1:].strip().strip("'\""))
        elif inside and line.strip() and not line[0].isspace():
            inside = False
    return found


def entry_point(manifest: dict) -> str | None:
    """exports["."], through import, default, require up to three deep; else main."""
    value = manifest.get("exports")
    value = value.get(".") if isinstance(value, dict) and "." in value else value if isinstance(value, str) else None
    for _ in range(3):
        if isinstance(value, dict):
            value = next((value[k] for k in ("import", "default", "require") if k in value), None)
    return value if isinstance(value, str) else manifest.get("main")


def _text(path: Path) -> str | None:
    return path.read_text() if path.exists() else None


def _manifests(top: Path) -> list[Path]:
    """All package.json below top; ignored folders aren't entered."""
    out = []
    for folder, folders, files in os.walk(top):
        folders[:] = [f for f in folders if f not in IGNORED_FOLDERS]
        if "package.json" in files:
            out.append(Path(folder) / "package.json")
    return out


def workspace_root(start: str, levels: int = 6) -> tuple[str, str]:
    """The folder above start, or start, that has workspaces, and the way from it to start (the offset of a scan's paths).

    The search ends at a repository's top and after so many levels; without a find it is start itself.
    """
    here = Path(start).resolve()
    for folder in [here, *here.parents][: levels + 1]:
        if workspace_globs(_text(folder / "package.json"), _text(folder / "pnpm-workspace.yaml")):
            offset = here.relative_to(folder).as_posix()
            return str(folder), "" if offset == "." else offset
        if (folder / ".git").exists():
            break
    return str(here), ""


def below_offset(packages: DataFrame, offset: str) -> DataFrame:
    """packages with folders as a scan of the folder at the offset names its paths; those outside of it go."""
    if not offset:
        return packages
    return packages.where(F.col("dir").startswith(offset + "/")).withColumn("dir", F.expr(f"substring(dir, {len(offset) + 2})"))


def head_of(root: str, timeout: int = 15) -> str | None:
    """The short hash of the tree's commit; None where there is none."""
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=timeout, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def newest(files: DataFrame) -> DataFrame:
    """One row: when the newest file below src/ that is a script was modified."""
    return files.where(F.col("path").rlike(r"^src/.*\.(ts|tsx|js|jsx)\z")).agg(F.max("modified").alias("modified"))


def packages(spark: SparkSession, root: str) -> DataFrame:
    """name, dir, entry of a monorepo's packages; of equal names the first. A listing of manifests on the driver."""
    top = Path(root)
    globs = workspace_globs(_text(top / "package.json"), _text(top / "pnpm-workspace.yaml"))
    rows: dict[str, tuple[str, str, str | None]] = {}
    for p in sorted(_manifests(top)) if globs else []:
        folder = p.parent.relative_to(top).as_posix()
        if folder == ".":
            continue
        fits = lambda g: fnmatchcase(folder, g.replace("**", "*").rstrip("/")) and ("**" in g or folder.count("/") == g.rstrip("/").count("/"))
        if any(fits(g) for g in globs if g[0] != "!") and not any(fits(g[1:]) for g in globs if g[0] == "!"):
            m = _manifest(p.read_text())
            if m.get("name"):
                entry = entry_point(m)
                rows.setdefault(m["name"], (m["name"], folder, entry and entry.removeprefix("./")))
    return spark.createDataFrame(list(rows.values()), "name string, dir string, entry string")


def git_log(spark: SparkSession, root: str, *, names_only: bool = False, days: int = 30, timeout: int = 15) -> DataFrame:
    """repo, pos, line of the last days' log; no rows where there is no repository."""
    form = ["--format=%H", "--name-only"] if names_only else ["--format=%h|%aI|%s", "--numstat"]
    try:
        out = subprocess.run(["git", "-C", root, "log", f"--since={days} days ago", *form], capture_output=True, text=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        out = ""
    return spark.createDataFrame([(root, i, x) for i, x in enumerate(out.split("\n"))], "repo string, pos long, line string")
