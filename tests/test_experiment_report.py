import pytest
from pyspark.sql import functions as F

from kelpline.operators import experiments as E
from kelpline.plans import experiment_report as T
from kelpline.plans.report import text
from kelpline.sources import experiment_files as J

TRIALS = "condition string, condition_name string, question string, task_type string, text string, trial long, assertion string, verdict string, reasoning string, tokens_in long, tokens_out long, latency double, tools long"


@pytest.fixture
def trials(spark):
    rows = []
    said = [(1, "c1", "q1", "PASS", "PASS", 0), (2, "c1", "q1", "PASS", "FAIL", 3), (3, "c1", "q1", "PASS", "PASS", None), (4, "c2", "q1", "PASS", "FAIL", 0), (5, "c2", "q1", "PASS", "FAIL", None), (6, "c2", "q1", "PASS", "FAIL", None), (7, "c1", "q2", "PASS", "PARTIAL", 1), (8, "c2", "q2", "FAIL", "FAIL", None)]
    for trial, c, q, a, b, tools in said:
        for assertion, verdict in (("a", a), ("b", b)):
            rows.append((c, {"c1": "Plain", "c2": "Full map"}[c], q, {"q1": "trace", "q2": "count"}[q], "w" * {"q1": 80, "q2": 81}[q], trial, assertion, verdict, f"for {trial}", 1_000_000, 100_000, 250.0 * trial, tools))
    return spark.createDataFrame(rows, TRIALS)


def test_stats_report(trials):
    assert text(T.stats_report(trials, 40)) == """=== CONDITION COMPARISON ===

  Plain                    0.79 +/- 0.04  (min 0.75, max 0.83)
  Full map                 0.25 +/- 0.25  (min 0.00, max 0.50)

  Cliff's Delta (c1 vs c2):  +1.00 [large]  CI: [1, 1]
  Win rate: c1 wins 2/2, ties 0, loses 0

    Plain                PASS 75% | PARTIAL 13% | FAIL 13%
    Full map             PASS 38% | PARTIAL 0% | FAIL 63%

=== ASSERTION DIAGNOSTICS ===

  NON-DISCRIMINATING:
  ! q1: "a"
    PASS across all conditions (max diff 0.0%)
  ! q2: "b"
    FAIL across all conditions (max diff 0.0%)

  FLAKY:
  ~ q1: "b"
    CV=0.71 in condition c1 (trials: 1, 0, 1)

  NEGATIVE SIGNAL:
  v q1: "Full map vs Plain"
    "Full map" (0.50) scores lower than "Plain" (0.83)
  v q2: "Full map vs Plain"
    "Full map" (0.00) scores lower than "Plain" (0.75)

  BUDGET SUMMARY:
    Wasted on non-discriminating: ~$18.00
    Recoverable from redundant:   ~$0.00
    Total savings available:       ~50%

=== TOOL USAGE ===

  Plain                        avg calls: 1.3  self-sufficient: 33%  (3 trials)
  Full map                     avg calls: 0.0  self-sufficient: 100%  (1 trials)

"""


def test_stats_without_tools_or_diagnostics(trials):
    one = trials.where("trial = 1").withColumn("tools", F.lit(None).cast("long"))
    got = text(T.stats_report(one, 10)).split("\n")
    assert "=== TOOL USAGE ===" not in got and got[3:6] == ["", "", "    Plain                PASS 100% | PARTIAL 0% | FAIL 0%"]
    assert got[7:11] == ["=== ASSERTION DIAGNOSTICS ===", "", "  BUDGET SUMMARY:", "    Wasted on non-discriminating: ~$0.00"]


def test_comparison_report(trials):
    after = trials.where("trial < 7").withColumn("verdict", F.when(F.col("condition") == "c2", "PASS").otherwise(F.when(F.col("trial") == 1, "PASS").otherwise("FAIL")))
    assert text(T.comparison_report(trials, after, ("first", "second"))) == """=== ITERATION COMPARISON: first -> second ===

  Plain                    0.83 -> 0.33  (-0.50)  Cliff's d=-1.00
  Full map                 0.50 -> 1.00  (+0.50)  Cliff's d=1.00

  IMPROVEMENTS:
    q1 [c2]: 0.50 -> 1.00

  REGRESSIONS:
    q1 [c1]: 0.83 -> 0.33

  Cost: $36.00 -> $27.00 ($-9.00)
"""


def test_markdown_report(trials):
    whole = text(T.markdown_report(trials.where("not (condition = 'c2' and question = 'q2')"), "run", "one, two", "2024-02-03", 61_500))
    assert whole.startswith("""## Results: run

*one, two — 2024-02-03*

### Overall Scores by Condition

| Condition | Avg Score | Avg Tokens (in) | Avg Latency |
|-----------|-----------|------------------|-------------|
| Plain | 0.79 | 1,000,000 | 0.8s |
| Full map | 0.50 | 1,000,000 | 1.3s |

### Scores by Task Type

| Task Type | Plain | Full map |
|-----------|-----------|-----------|
| count | 0.75 | — |
| trace | 0.83 | 0.50 |

### Per-Question Detail

<details><summary><strong>q1</strong> (trace) — """ + "w" * 80 + """</summary>

**Plain**: avg 0.83 (trials: 1.00, 0.50, 1.00)
  + PASS: a — for 1
  + PASS: b — for 1

**Full map**: avg 0.50 (trials: 0.50, 0.50, 0.50)
  + PASS: a — for 4
  - FAIL: b — for 4

</details>

<details><summary><strong>q2</strong> (count) — """ + "w" * 79 + "…</summary>\n")
    assert whole.endswith("""  ~ PARTIAL: b — for 7

</details>

### Cost Summary

- **API calls**: 7
- **Tokens**: 7,000,000 in / 700,000 out
- **Estimated cost**: $31.50
- **Duration**: 62s

""")


def test_markdown_of_one_type_and_unscored_trials(trials):
    one = trials.where("question = 'q2'").withColumns({"verdict": F.when(F.col("trial") == 7, F.col("verdict")), "assertion": F.when(F.col("trial") == 7, F.col("assertion"))})
    whole = text(T.markdown_report(one, "run", "one", "now"))
    assert "Task Type" not in whole and "**Full map**: avg 0.00 (trials: ?)\n\n</details>" in whole


def test_judge_report(spark):
    rows = [(0, "q1", "a", i, v) for i, v in enumerate(("PASS", "PASS", "PASS"))] + [(1, "q2", "b", i, v) for i, v in enumerate(("PASS", "FAIL", "PASS"))]
    schema = "ord long, question string, assertion string, repetition int, verdict string"
    assert text(T.judge_report(spark.createDataFrame(rows, schema))) == """=== JUDGE CALIBRATION ===

  Sample size: 2 pairs x 3 repetitions
  Consistency: 50%
  Verdict distribution: PASS 83% | PARTIAL 0% | FAIL 17%
  WARNING: PARTIAL underuse detected — judge may be binary

  INCONSISTENT PAIRS:
    q2: "b" -> [PASS, FAIL, PASS]

"""
    assert text(T.judge_report(spark.createDataFrame([], schema))).split("\n")[2:4] == ["  Sample size: 0 pairs x 0 repetitions", "  Consistency: 100%"]


def test_advice_report(spark):
    reply = 'REWRITE: [q7] "says so"\nPROBLEM: vague\nNEW: "says why"\nWHY: can be told\nCONDITION: drop one\nSAVINGS: a third'
    rows = spark.createDataFrame([(reply,)], "t string").select(J.advice(F.col("t")).alias("a")).select("a.*")
    assert text(T.advice_report(rows)) == """=== RECOMMENDATIONS ===

  ASSERTION REWRITES:

  q7: "says so"
    Problem: vague
    Rewrite: "says why"
    Why: can be told

  CONDITION SUGGESTIONS:

  - drop one

  ESTIMATED SAVINGS: a third
"""


def test_reports_of_nothing(trials):
    none = trials.limit(0)
    assert "=== CONDITION COMPARISON ===" in text(T.stats_report(none, 5))
    assert "- **API calls**: 0" in text(T.markdown_report(none, "run", "", "now"))
    assert text(T.comparison_report(none, none, ("a", "b"))).startswith("=== ITERATION COMPARISON: a -> b ===\n\n\n  Cost: $0.00")
    assert E.tool_usage(none).count() == 0
