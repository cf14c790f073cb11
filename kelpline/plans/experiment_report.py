"""Reports of evaluation experiments as DataFrames of lines, like those of plans/report.py.

trials are as in operators/experiments.py; condition_name, task_type, text (the question's) and
reasoning are shown where there are such columns. Conditions, the arms of an experiment, are few;
all else may be large: lines of results are sorted and written by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import kept
from ..functions.render import fixed, grouped, padded, plain_number
from ..operators import experiments as E
from .report import combined, lines, section

# Titles and marks that readers of a report look for.
STATS, DIAGNOSTICS, TOOLS, JUDGE = "=== CONDITION COMPARISON ===", "=== ASSERTION DIAGNOSTICS ===", "=== TOOL USAGE ===", "=== JUDGE CALIBRATION ==="
KINDS = {"non-discriminating": ("NON-DISCRIMINATING", "!"), "flaky": ("FLAKY", "~"), "redundant": ("REDUNDANT", "#"), "negative-signal": ("NEGATIVE SIGNAL", "v")}
PHASES = {"non-discriminating": 0, "flaky": 0, "redundant": 1, "negative-signal": 2}
VERDICT_MARKS = {"PASS": "+", "PARTIAL": "~"}
LOW, HIGH = float("-inf"), float("inf")


def _signed(x: Column, digits: int, plus: bool = True) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise("+" if plus else ""), fixed(F.abs(x), digits))


def _percent(x: Column) -> Column:
    return F.concat(fixed(x * 100, 0), F.lit("%"))


def _fixed_lines(df: DataFrame, *texts: str, k1: float = LOW) -> DataFrame:
    """Lines that don't depend on rows."""
    one = df.sparkSession.range(1)
    out = [lines(one, F.lit(t), k1, sub=i) for i, t in enumerate(texts)]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def conditions(trials: DataFrame) -> DataFrame:
    """condition, name, ord: arms in the order they are first seen."""
    name = "condition_name" if "condition_name" in trials.columns else "condition"
    return trials.groupBy("condition").agg(F.min_by(name, "trial").alias("name"), F.min("trial").alias("ord"))


def _diagnostic_lines(found: DataFrame) -> list[DataFrame]:
    """Kinds as they are first met, result by result; in a kind by result, then as assertions are first seen (negative signals: the better score first)."""
    rank = lambda of: F.coalesce(*[F.when(F.col("kind") == k, of(i, k)) for i, k in enumerate(KINDS)])
    met = found.groupBy("kind").agg(F.min(F.struct("_ord", rank(lambda i, k: F.lit(PHASES[k])).alias("p"), "first", rank(lambda i, k: F.lit(i)).alias("i"))).alias("_met"))
    kinds = kept(met.select("kind", F.row_number().over(Window.orderBy("_met")).cast("double").alias("_kind")))  # a row for each of four kinds
    rows = found.join(kinds, "kind").withColumn("_at", F.concat_ws(" ", F.format_string("%020.9f", "first"), F.format_string("%020.9f", "second"), "assertion"))
    mark = rank(lambda i, k: F.lit(KINDS[k][1]))
    said = F.concat(F.lit("  "), mark, F.lit(" "), F.col("question").cast("string"), F.lit(': "'), "assertion", F.lit('"'))
    return [
        lines(kinds, F.concat(F.lit("  "), rank(lambda i, k: F.lit(KINDS[k][0])), F.lit(":")), F.col("_kind"), LOW),
        lines(rows, said, F.col("_kind"), F.col("_ord"), F.col("_at"), 1),
        lines(rows, F.concat(F.lit("    "), "detail"), F.col("_kind"), F.col("_ord"), F.col("_at"), 2),
        lines(kinds, F.lit(""), F.col("_kind"), HIGH),
    ]


def stats_report(trials: DataFrame, times: int = 1000) -> DataFrame:
    """Conditions by mean score, comparisons of their pairs, shares of verdicts, diagnostics, budget, and use of tools if any is known. times: bootstrap resamples."""
    trials = kept(trials)
    arms = kept(conditions(trials))
    scores = kept(E.question_scores(trials))
    stats = kept(E.condition_stats(trials).join(arms, "condition"))
    two = lambda c: fixed(F.col(c), 2)
    line = F.concat(F.lit("  "), padded(F.col("name"), 24), F.lit(" "), two("mean"), F.lit(" +/- "), two("deviation"), F.lit("  (min "), two("least"), F.lit(", max "), two("most"), F.lit(")"))
    first = section(1, None, [_fixed_lines(trials, STATS, ""), lines(stats, line, -F.col("mean"), F.col("ord"))])

    of = lambda n: arms.select(F.col("condition").alias(n), F.col("ord").alias(f"_{n}"))
    pairs = E.cliffs_delta(scores).join(E.bootstrap(scores, times), ["a", "b"]).join(E.win_rates(scores), ["a", "b"]).join(of("a"), "a").join(of("b"), "b")
    pairs = kept(pairs)
    delta = F.concat(F.lit("  Cliff's Delta ("), "a", F.lit(" vs "), "b", F.lit("):  "), _signed(F.col("delta"), 2), F.lit(" ["), "magnitude", F.lit("]  CI: ["), plain_number(F.col("lo")), F.lit(", "), plain_number(F.col("hi")), F.lit("]"))
    count = lambda c: F.col(c).cast("string")
    wins = F.concat(F.lit("  Win rate: "), "a", F.lit(" wins "), count("wins"), F.lit("/"), count("total"), F.lit(", ties "), count("ties"), F.lit(", loses "), count("losses"))
    second = section(2, None, [lines(pairs, x, F.col("_a"), F.col("_b"), sub=i) for i, x in enumerate((delta, wins))], always=True)

    shares = F.concat(F.lit("    "), padded(F.col("name"), 20), F.lit(" PASS "), _percent(F.col("passed")), F.lit(" | PARTIAL "), _percent(F.col("partial")), F.lit(" | FAIL "), _percent(F.col("failed")))
    third = section(3, None, [lines(stats, shares, -F.col("mean"), F.col("ord"))], always=True)

    keys = E.result_keys(trials)
    found = kept(E.diagnostics(trials, ordered=True).join(trials.groupBy(*keys).agg(F.min("trial").alias("_ord")), keys))
    fourth = section(4, None, [_fixed_lines(trials, DIAGNOSTICS, ""), *_diagnostic_lines(found)], end=False)

    cost = E.budget(trials, found, E.summary(trials))
    money = lambda text, c: F.concat(F.lit(text), two(c))
    texts = [F.lit("  BUDGET SUMMARY:"), money("    Wasted on non-discriminating: ~$", "wasted_on_non_discriminating"), money("    Recoverable from redundant:   ~$", "recoverable_from_redundant"), F.concat(F.lit("    Total savings available:       ~"), count("savings_percent"), F.lit("%"))]
    fifth = section(5, None, [lines(cost, x, sub=i) for i, x in enumerate(texts)])

    tools = E.tool_usage(trials).join(trials.where("tools is not null").groupBy("condition").agg(F.min("trial").alias("_first")), "condition").join(arms, "condition")
    used = F.concat(F.lit("  "), padded(F.col("name"), 28), F.lit(" avg calls: "), fixed(F.col("mean_tools"), 1), F.lit("  self-sufficient: "), _percent(F.col("none")), F.lit("  ("), count("trials"), F.lit(" trials)"))
    sixth = section(6, TOOLS, [lines(tools, used, F.col("_first")), lines(tools.limit(1), F.lit(""), LOW, sub=1)])
    return combined([first, second, third, fourth, fifth, sixth])


def comparison_report(before: DataFrame, after: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two runs' trials: a line for each condition that both have, then questions that went up, and down, by more than 0.1, then costs. Conditions and questions as the run before has them."""
    before, after = kept(before), kept(after)
    rows = E.compare(E.last_scores(before), E.last_scores(after))
    rows = kept(rows.join(conditions(before).withColumnRenamed("ord", "_c"), "condition").join(before.groupBy("condition", "question").agg(F.min("trial").alias("_q")), ["condition", "question"]))
    arms = E.condition_deltas(rows).join(rows.select("condition", "name", "_c").distinct(), "condition")
    two = lambda c: fixed(F.col(c), 2)
    line = F.concat(F.lit("  "), padded(F.col("name"), 24), F.lit(" "), two("before"), F.lit(" -> "), two("after"), F.lit("  ("), _signed(F.col("delta"), 2), F.lit(")  Cliff's d="), _signed(F.col("cliffs_delta"), 2, plus=False))
    out = [section(1, None, [_fixed_lines(before, f"=== ITERATION COMPARISON: {names[0]} -> {names[1]} ===", ""), lines(arms, line, F.col("_c"))])]
    one = F.concat(F.lit("    "), F.col("question").cast("string"), F.lit(" ["), "condition", F.lit("]: "), two("before"), F.lit(" -> "), two("after"))
    for i, (title, kind) in enumerate((("  IMPROVEMENTS:", "improvement"), ("  REGRESSIONS:", "regression"))):
        out.append(section(2 + i, title, [lines(rows.where(F.col("change") == kind), one, F.col("_c"), F.col("_q"))]))
    costs = E.iteration_costs(before, after)
    dollars = F.concat(F.lit("  Cost: $"), two("cost_before"), F.lit(" -> $"), two("cost_after"), F.lit(" ("), F.when(F.col("cost_after") >= F.col("cost_before"), "+").otherwise(""), F.lit("$"), _signed(F.col("cost_after") - F.col("cost_before"), 2, plus=False), F.lit(")"))
    out.append(section(4, None, [lines(costs, dollars)], end=False))
    return combined(out)


def _table_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_report(trials: DataFrame, name: str, codebases: str, stamp: str, duration_ms: int = 0) -> DataFrame:
    """Conditions as first seen, a table of task types by condition if there are several types, each result with its conditions and the assertions of their first trials, and costs.

    The table's columns are the conditions that the data have. latency is in milliseconds.
    """
    trials = kept(trials)
    arms, keys = kept(conditions(trials)), E.result_keys(trials)
    # A trial's tokens and time are in each of its assertions' rows.
    each = kept(trials.groupBy("condition", *keys, "trial").agg(F.max("tokens_in").alias("i"), F.max("latency").alias("ms"), F.when(F.count("verdict") > 0, F.sum(E.score()) / F.count("verdict")).alias("s")))
    scores = kept(E.question_scores(trials))
    stats = scores.groupBy("condition").agg(F.avg("score").alias("score")).join(each.groupBy("condition").agg(F.avg("i").alias("i"), F.avg("ms").alias("ms")), "condition").join(arms, "condition")
    head = section(1, None, [_fixed_lines(trials, f"## Results: {name}", "", f"*{codebases} — {stamp}*", "", "### Overall Scores by Condition", "", "| Condition | Avg Score | Avg Tokens (in) | Avg Latency |", "|-----------|-----------|------------------|-------------|"), lines(stats, _table_row([F.col("name"), fixed(F.col("score"), 2), grouped(F.floor(F.col("i") + 0.5)), F.concat(fixed(F.col("ms") / 1000, 1), F.lit("s"))]), F.col("ord"))])
    out = [head]

    found = [(r.condition, r.name) for r in arms.orderBy("ord").collect()]
    if "task_type" in trials.columns and E.task_types(trials).limit(2).count() > 1:
        typed = scores.join(trials.select(*keys, "task_type").distinct(), keys)
        table = typed.groupBy("task_type").pivot("condition", [c for c, _ in found]).agg(F.avg("score"))
        cells = [F.coalesce(fixed(F.col(f"`{c}`"), 2), F.lit("—")) for c, _ in found]
        titles = ["### Scores by Task Type", "", f"| Task Type | {' | '.join(n for _, n in found)} |", f"|-----------|{'|'.join('-----------' for _ in found)}|"]
        out.append(section(2, None, [_fixed_lines(trials, *titles), lines(table, _table_row([F.col("task_type"), *cells]), k3=F.col("task_type"))]))

    kind, text = ("task_type" if "task_type" in trials.columns else None), ("text" if "text" in trials.columns else "question")
    results = trials.groupBy(*keys).agg(F.min("trial").alias("_r"), F.first(F.col(kind) if kind else F.lit("")).alias("_kind"), F.first(F.col(text).cast("string")).alias("_text"))
    short = F.when(F.length("_text") <= 80, F.col("_text")).otherwise(F.concat(F.substring("_text", 1, 79), F.lit("…")))
    title = F.concat(F.lit("<details><summary><strong>"), F.col("question").cast("string"), F.lit("</strong> ("), "_kind", F.lit(") — "), short, F.lit("</summary>"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("trial", F.coalesce(fixed(F.col("s"), 2), F.lit("?")).alias("s")))), lambda t: t["s"])
    arm = each.groupBy("condition", *keys).agg(F.min("trial").alias("_t"), F.array_join(texts, ", ").alias("_all")).join(scores.drop("ord"), ["condition", *keys]).join(results.select(*keys, "_r"), keys).join(arms.drop("ord"), "condition")
    said = F.concat(F.lit("**"), "name", F.lit("**: avg "), fixed(F.col("score"), 2), F.lit(" (trials: "), "_all", F.lit(")"))
    tell = F.concat(F.lit(" — "), "reasoning") if "reasoning" in trials.columns else F.lit("")
    mark = F.coalesce(*[F.when(F.col("verdict") == v, m) for v, m in VERDICT_MARKS.items()], F.lit("-"))
    judged = trials.where("verdict is not null").join(arm.select("condition", *keys, "_r", F.col("_t").alias("trial")), ["condition", *keys, "trial"])
    verdict = F.concat(F.lit("  "), mark, F.lit(" "), "verdict", F.lit(": "), F.col("assertion").cast("string"), tell)
    at = lambda df, line, k2, sub, k3=None: lines(df, line, F.col("_r"), k2, k3, sub)
    detail = [
        at(results, title, LOW, 0), at(results, F.lit(""), LOW, 1),
        at(arm, said, F.col("_t"), 0), at(judged, verdict, F.col("trial"), 1, F.concat(F.lit("a"), F.col("assertion").cast("string"))), at(arm, F.lit(""), F.col("_t"), 2, F.lit("b")),
        at(results, F.lit("</details>"), HIGH, 0), at(results, F.lit(""), HIGH, 1),
    ]
    out.append(section(3, None, [_fixed_lines(trials, "### Per-Question Detail", ""), *detail], end=False))

    cost = E.summary(trials)
    texts = [F.concat(F.lit("- **API calls**: "), F.col("calls").cast("string")), F.concat(F.lit("- **Tokens**: "), grouped(F.col("tokens_in")), F.lit(" in / "), grouped(F.col("tokens_out")), F.lit(" out")), F.concat(F.lit("- **Estimated cost**: $"), fixed(F.col("cost"), 2)), F.lit(f"- **Duration**: {int(duration_ms / 1000 + 0.5)}s")]
    out.append(section(4, None, [_fixed_lines(trials, "### Cost Summary", ""), *[lines(cost, x, sub=i) for i, x in enumerate(texts)]]))
    return combined(out)


def judge_report(repeated: DataFrame) -> DataFrame:
    """repeated (question, assertion, repetition, verdict, ord): what a judge said of each sampled pair several times. Its consistency, its verdicts' shares, and the pairs it wasn't consistent on, by ord."""
    per = repeated.groupBy("ord", "question", "assertion").agg(F.transform(F.array_sort(F.collect_list(F.struct("repetition", "verdict"))), lambda v: v["verdict"]).alias("v")).withColumn("_same", F.size(F.array_distinct("v")) <= 1)
    sizes = per.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("_same").cast("double")), F.lit(1.0)).alias("consistent"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("times"))
    share = lambda v: F.coalesce(F.avg((F.col("verdict") == v).cast("double")), F.lit(0.0)).alias(v)
    bias = repeated.agg(*[share(v) for v in ("PASS", "PARTIAL", "FAIL")], F.count(F.lit(1)).alias("all"))
    shares = F.concat(F.lit("  Verdict distribution: "), F.concat_ws(" | ", *[F.concat(F.lit(f"{v} "), _percent(F.col(v))) for v in ("PASS", "PARTIAL", "FAIL")]))
    warn = F.when((F.col("PARTIAL") < 0.05) & (F.col("all") > 0), "  WARNING: PARTIAL underuse detected — judge may be binary")
    top = [
        lines(sizes, F.concat(F.lit("  Sample size: "), F.col("n").cast("string"), F.lit(" pairs x "), F.col("times").cast("string"), F.lit(" repetitions"))),
        lines(sizes, F.concat(F.lit("  Consistency: "), _percent(F.col("consistent"))), sub=1), lines(bias, shares, sub=2), lines(bias, warn, sub=3),
    ]
    first = section(1, None, [_fixed_lines(repeated, JUDGE, ""), *top], end=False)
    pair = F.concat(F.lit("    "), F.col("question").cast("string"), F.lit(': "'), F.col("assertion").cast("string"), F.lit('" -> ['), F.array_join("v", ", "), F.lit("]"))
    bad = per.where("not _same")
    some = bad.limit(1)
    second = section(2, None, [lines(some, F.lit(""), LOW), lines(some, F.lit("  INCONSISTENT PAIRS:"), LOW, sub=1), lines(bad, pair, F.col("ord"))], end=False)
    return combined([first, second, section(3, None, [_fixed_lines(repeated, "")], end=False)])


def advice_report(advice: DataFrame, title: str = "=== RECOMMENDATIONS ===") -> DataFrame:
    """advice: one row as sources/experiment_files.advice() gives it (rewrites, conditions, questions, savings)."""
    out = [section(1, None, [_fixed_lines(advice, title, "")], end=False)]
    r = advice.select(F.posexplode("rewrites").alias("k", "r")).select("k", "r.*")
    said = lambda text, c: F.concat(F.lit(text), c)
    texts = [F.concat(F.lit("  "), "question", F.lit(': "'), "assertion", F.lit('"')), said("    Problem: ", "problem"), F.concat(F.lit('    Rewrite: "'), "rewrite", F.lit('"')), said("    Why: ", "why"), F.lit("")]
    out.append(section(2, None, [lines(r.limit(1), F.lit("  ASSERTION REWRITES:"), LOW), lines(r.limit(1), F.lit(""), LOW, sub=1), *[lines(r, x, F.col("k"), sub=i) for i, x in enumerate(texts)]], end=False))
    for i, (name, c) in enumerate((("CONDITION", "conditions"), ("QUESTION", "questions"))):
        s = advice.select(F.posexplode(c).alias("k", "s"))
        out.append(section(3 + i, None, [lines(s.limit(1), F.lit(f"  {name} SUGGESTIONS:"), LOW), lines(s.limit(1), F.lit(""), LOW, sub=1), lines(s, said("  - ", "s"), F.col("k")), lines(s.limit(1), F.lit(""), HIGH)], end=False))
    out.append(section(5, None, [lines(advice, F.when(F.col("savings") != "", said("  ESTIMATED SAVINGS: ", "savings")))], end=False))
    return combined(out)
