"""Plans (markdown) held against the code graph: files they name, and steps that lack a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import grows, kept
from ..functions.extract import ARCHITECTURE, plan_paths
from ..functions.render import fixed


def named_files(plans: DataFrame) -> DataFrame:
    """plans (plan, text) to plan, path."""
    return plans.select("plan", F.explode(plan_paths(F.col("text"))).alias("path"))


def against_graph(paths: DataFrame, nodes: DataFrame, risk: DataFrame | None = None, churn: DataFrame | None = None) -> DataFrame:
    """plan, path, known, and where given: amplification, affected, high_cascade, commits."""
    out = paths.join(nodes.select(F.col("id").alias("path"), F.lit(True).alias("known")), "path", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    if risk is not None:
        out = out.join(risk.select(F.col("node").alias("path"), "amplification", "affected"), "path", "left").withColumn("high_cascade", F.coalesce(F.col("amplification") >= 2, F.lit(False)))
    if churn is not None:
        out = out.join(churn.select("path", "commits"), "path", "left")
    return out


def steps(plans: DataFrame) -> DataFrame:
    """plan, step (from 1), heading, body: the stretches after ### headings."""
    cut = plans.select("plan", F.posexplode(F.split(F.concat(F.lit("\n"), F.col("text")), r"\n(?=###\s+\S)", -1)).alias("step", "part")).where(F.col("step") > 0)
    return cut.select("plan", "step", F.regexp_extract("part", r"^###\s+([^\n]+)", 1).alias("heading"), F.regexp_replace("part", r"^[^\n]*", "").alias("body"))


def missing_checkpoints(plans: DataFrame, ahead: int = 2) -> DataFrame:
    """plan, step, heading, files of steps that create, split, delete, merge or move files with no [CHECKPOINT] heading in the next steps."""
    rows = steps(plans).withColumn("_all", F.concat(F.lit("### "), F.col("heading"), F.col("body")))
    window = Window.partitionBy("plan").orderBy("step").rowsBetween(1, ahead)
    rows = rows.withColumn("_next", F.coalesce(F.max(F.lower("heading").contains("[checkpoint]")).over(window), F.lit(False)))
    changes = F.lit(False)
    for p in ARCHITECTURE:
        changes = changes | F.col("_all").rlike(p)
    return rows.where(changes & ~F.col("_next")).select("plan", F.col("step").cast("long").alias("step"), "heading", F.regexp_extract_all("_all", F.lit(r"`([^`]*/[^`]+)`"), F.lit(1)).alias("files"))


def _new_kind():
    """What a path that isn't there yet will be, as far as its name tells."""
    return F.when(F.col("path").rlike(r"/api/.*route\.(ts|js)\z"), "api-route").when(F.col("path").rlike(r"/page\.(tsx|jsx)\z"), "route")


def findings(plans: DataFrame, nodes: DataFrame, risk: DataFrame, churn: DataFrame, tests: DataFrame, found: DataFrame, since: str | None = None, checkpoints: bool = False) -> DataFrame:
    """A plan's report as rows: plan, kind, path, line.

    Kinds: stale (changed in the last days, or since an ISO date), high-cascade (amplification of
    2 or more), missing-convention, new-file, summary and, if asked, checkpoint. tests: node and
    tests; found: modules.conventions().
    """
    s = lambda c: F.col(c).cast("string")
    rows = named_files(plans).join(grows(nodes.select(F.col("id").alias("path"), "exports", F.lit(True).alias("known"))), "path", "left")
    rows = rows.join(grows(risk.where("affected > 1").select(F.col("node").alias("path"), "direct", "affected", "max_depth", "amplification")), "path", "left")
    rows = rows.join(grows(churn.drop("last_commit")), "path", "left").join(grows(tests.select(F.col("node").alias("path"), "tests")), "path", "left")
    # Read by each kind and by the sums.
    rows = kept(rows)
    known = F.col("known").isNotNull()
    fresh = F.lit(True) if since is None else F.col("last_date") >= F.to_timestamp(F.lit(since))
    cascade = F.concat(F.lit("amp"), fixed(F.col("amplification"), 1), F.lit(" ×"), s("direct"), F.lit("→"), s("affected"), F.lit(" d"), s("max_depth"))
    high = F.col("amplification") >= 2
    shown = F.slice(F.filter(F.coalesce("exports", F.array().cast("array<string>")), lambda x: x != "default"), 1, 5)
    of = lambda kind, which, line: rows.where(which).select("plan", F.lit(kind).alias("kind"), "path", line.alias("line"))
    stale = of("stale", known & (F.col("commits") > 0) & fresh, F.concat_ws("; ", F.concat(s("commits"), F.lit(" commits, +"), s("added"), F.lit(" -"), s("removed"), F.lit(" lines")), F.concat(F.lit('last: "'), F.coalesce("last_message", F.lit("")), F.lit('" ('), F.substring(s("last_date"), 1, 10), F.lit(")")), F.when(F.col("direct").isNotNull(), F.concat(F.lit("RISK: "), F.when(high, "[AMP] ").otherwise(""), cascade))))
    wide = of("high-cascade", known & high, F.concat_ws("; ", F.concat(F.lit("RISK: [AMP] "), cascade), F.when(F.size(shown) > 0, F.concat(F.lit("exports: "), F.array_join(shown, ", "))), F.concat(F.lit("tests: "), F.coalesce(s("tests"), F.lit("0")))))
    new = of("new-file", ~known, F.lit(""))
    label = F.coalesce(F.nullif(F.array_join(F.slice(F.coalesce("e", F.array().cast("array<string>")), 1, 2), ", "), F.lit("")), F.regexp_replace(F.regexp_extract("anchor", r"([^/]*)\z", 1), r"\.\w+\z", ""))
    due = new.select("plan", _new_kind().alias("consumer")).where("consumer is not null").distinct()
    gaps = due.join(found, "consumer").join(grows(nodes.select(F.col("id").alias("anchor"), F.col("exports").alias("e"))), "anchor", "left")
    gaps = gaps.select("plan", F.lit("missing-convention").alias("kind"), F.col("anchor").alias("path"), F.concat(F.lit("adds "), "consumer", F.lit(" but may not import "), label, F.lit(" ("), s("adoption"), F.lit("/"), s("total"), F.lit(" use it)")).alias("line"))
    out = stale.unionByName(wide).unionByName(new)
    n = lambda k: F.count_if(F.col("kind") == k).cast("string")
    sums = plans.select("plan").join(out, "plan", "left").groupBy("plan").agg(F.concat(n("stale"), F.lit(" stale, "), n("high-cascade"), F.lit(" high-cascade, "), n("new-file"), F.lit(" new files")).alias("line"))
    out = out.unionByName(gaps).unionByName(sums.select("plan", F.lit("summary").alias("kind"), F.lit("").alias("path"), "line"))
    if checkpoints:
        out = out.unionByName(missing_checkpoints(plans).select("plan", F.lit("checkpoint").alias("kind"), F.col("heading").alias("path"), F.array_join("files", ", ").alias("line")))
    return out
