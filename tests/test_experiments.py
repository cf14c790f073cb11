import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from kelpline.functions import draws
from kelpline.operators import experiments as E
from kelpline.sources import experiment_files as J

TRIALS = "condition string, question long, assertion long, trial long, verdict string, latency double, tools long, tokens_in long, tokens_out long"


def trials(spark, rows):
    return spark.createDataFrame([(c, q, a, i, v, 1.0, t, 10, 2) for i, (c, q, a, v, t) in enumerate(rows)], TRIALS)


def scores(spark, **by):
    return spark.createDataFrame([(c, i, float(x), 100 * k + i) for k, (c, xs) in enumerate(by.items()) for i, x in enumerate(xs)], "condition string, question long, score double, ord long")


def test_deltas_and_wins(spark):
    # The order is that in which conditions are seen, and not by name; the longer list's end has no match.
    s = scores(spark, z=[0.9, 0.25, 0.6, 0.31, 1.0], a=[0.4, 0.25, 0.75, 0.3])
    w = E.win_rates(s).first()
    assert (w.a, w.b, w.wins, w.losses, w.ties, w.total) == ("z", "a", 2, 1, 1, 4)
    above = sum((x > y) - (x < y) for x in [0.9, 0.25, 0.6, 0.31, 1.0] for y in [0.4, 0.25, 0.75, 0.3])
    assert E.cliffs_delta(s).first().delta == pytest.approx(above / 20)
    low = E.cliffs_delta(scores(spark, a=[0, 0], b=[1, 1])).first()
    assert (low.delta, low.magnitude) == (-1.0, "large")
    ci = E.bootstrap(s).first()
    assert -1 <= ci.lo <= above / 20 <= ci.hi <= 1
    assert (ci.lo, ci.hi) == resampled("z", "a", [0.9, 0.25, 0.6, 0.31, 1.0], [0.4, 0.25, 0.75, 0.3], 1000)
    assert E.sampled(trials(spark, [("x", 1, 0, "PASS", 0)] * 9), 4).count() == 4


def test_bootstrap_draws(spark):
    # Twelve scores have numbers of one and two digits; blocks of four places, by pieces of two; 150 resamples are two cells.
    x, y = [k % 5 / 4 for k in range(12)], [k % 3 / 2 for k in range(7)]
    ci = E.bootstrap(scores(spark, z=x, a=y), 150, piece=2, block=2).first()
    assert (ci.lo, ci.hi) == resampled("z", "a", x, y, 150)
    for text in (b"a|b|1|a|", b"y" * 53, b"q" * 130):
        for first, stop in draws.tiles(12_000):
            heads = draws.Draws(first, stop).heads(text)
            for n in (first, (first + stop) // 2, stop - 1):
                assert heads[n - first] == int(hashlib.md5(text + b"%d" % n).hexdigest()[:8], 16)


def resampled(a, b, x, y, times):
    """The same draws, one by one."""

    def draw(side, values, i, k):
        return values[int(hashlib.md5(f"{a}|{b}|{i}|{side}|{k + 1}".encode()).hexdigest()[:8], 16) % len(values)]

    deltas = []
    for i in range(times):
        p, q = ([draw(side, v, i, k) for k in range(len(v))] for side, v in (("a", x), ("b", y)))
        deltas.append(sum((u > v) - (u < v) for u in p for v in q) / (len(p) * len(q)))
    deltas.sort()
    return tuple(math.floor(deltas[int(share * times)] * 100 + 0.5) / 100 for share in (0.025, 0.975))


def test_resume_summary_and_diagnostics(spark):
    t = trials(spark, [("x", 1, 0, v, 0) for v in ("PASS", "FAIL", "PASS")] + [("y", 1, 0, "PASS", 1)] * 3 + [("x", 2, 0, "PASS", 0), ("y", 2, 0, "PASS", 0)])
    s = E.summary(t).first()
    assert (s.calls, s.tokens_in, s.tokens_out) == (8, 80, 16) and s.cost == pytest.approx(80 / 1e6 * 3 + 16 / 1e6 * 15)
    named = t.withColumn("condition_name", F.when(F.col("condition") == "x", "The Full one").otherwise("bare"))
    found = {(r.question, r.kind): (r.assertion, r.detail) for r in E.diagnostics(named).collect()}
    assert found == {
        (1, "flaky"): ("0", "CV=0.71 in condition x (trials: 1, 0, 1)"),
        (1, "negative-signal"): ("The Full one vs bare", '"The Full one" (0.67) scores lower than "bare" (1.00)'),
        (2, "non-discriminating"): ("0", "PASS across all conditions (max diff 0.0%)"),
    }
    keys = "question string, codebase string, condition string"
    wanted = spark.createDataFrame([(q, "c", k) for q in "pq" for k in "xy"], keys)
    done = spark.createDataFrame([("p", "c", "x", True), ("p", "c", "y", False)], keys + ", done boolean")
    assert {(r.question, r.condition) for r in E.remaining(wanted, done).collect()} == {("p", "y"), ("q", "x"), ("q", "y")}
    by = E.by_task(t.withColumn("task_type", F.lit("t")), ["x", "y"]).first()
    assert by.y == 1.0 and E.condition_deltas(E.compare(scores(spark, a=[0.5, 0.1]), scores(spark, a=[0.9, 0.1]))).first().improvements == 1


def test_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"name": "n", "codebases": [{"id": "c"}],\n"conditions": [{"id": "k"}], "questions": [{"id": "q", "text": "?", "taskType": "t"}], "trials": 5}')
    config = J.read_config(spark, str(tmp_path / "c.json"))
    r = config.first()
    assert (r.trials, r.maxTokens, r.delayMs) == (5, 1024, 600) and J.wanted(config).collect() == [("q", "c", "k")]
    assert E.with_questions(spark.createDataFrame([("q", 1), ("gone", 2)], "question string, x long"), J.questions(config)).count() == 1
    (tmp_path / "bad.json").write_text('{"name": "n"}')
    with pytest.raises(Exception, match="a configuration needs"):
        J.read_config(spark, str(tmp_path / "bad.json")).collect()
    rows = spark.createDataFrame([("r", "q", "t", "c", "k", "K", 1, 7, 3, 1.5, None, "a", "PASS", "so"), ("r", "q", "t", "c", "k", "K", 1, 7, 3, 1.5, None, "b", "FAIL", None)], "run string, question string, task_type string, codebase string, condition string, condition_name string, trial int, tokens_in long, tokens_out long, latency double, tools int, assertion string, verdict string, reasoning string")
    J.write_results(rows, str(tmp_path / "out"))
    assert sorted(map(str, J.read_results(spark, str(tmp_path / "out")).collect())) == sorted(map(str, rows.collect()))
    said = 'REWRITE: [q1] "old"\nPROBLEM: vague\nNEW: "new"\nWHY: clear\nQUESTION: more\nSAVINGS: some '
    a = spark.range(1).select(J.advice(F.lit(said)).alias("a")).first().a
    assert (a.rewrites[0].question, a.rewrites[0].why, a.questions, a.conditions, a.savings) == ("q1", "clear", ["more"], [], "some")


def test_stats_and_flags(spark):
    t = trials(spark, [("x", 1, 0, v, 0) for v in ("PASS", "FAIL", "PASS", "FAIL")] + [("y", 1, 0, "PASS", 2)] * 4 + [("x", 2, 1, "PASS", None)] * 3)
    r = {x.condition: x for x in E.condition_stats(t).collect()}
    assert r["x"].mean == 0.75 and r["x"].deviation == 0.25 and r["y"].passed == 1.0
    rates = E.assertion_rates(t)
    assert [(x.question, x.condition) for x in E.flaky(rates).collect()] == [(1, "x")]
    assert [(x.worse, x.better) for x in E.negative(t.replace({"x": "full"}, subset=["condition"])).collect()] == [("full", "y")]
    assert E.non_discriminating(rates).count() == 0
    assert {x.condition: (x.none, x.trials) for x in E.tool_usage(t).collect()} == {"x": (1.0, 4), "y": (0.0, 4)}
    assert {(x.condition, x.question) for x in E.early_stop(t).collect()} == {("y", 1), ("x", 2)}
    two = trials(spark, [("x", 1, a, v, 0) for _ in range(3) for a, v in ((0, "PASS"), (1, "FAIL"))]).withColumn("trial", F.floor(F.col("trial") / 2))
    assert E.early_stop(two).first().n == 3


def walk(lists):
    """What repeats what among assertions' lists of scores, and rho, by the definition."""

    def ranks(v):
        return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]

    out = []
    for i, a in enumerate(lists):
        for j in range(i + 1, len(lists)):
            n = min(len(a), len(lists[j]))
            p, q = ranks(a[:n]), ranks(lists[j][:n])
            rho = 0 if n < 3 else 1 - 6 * sum((x - y) ** 2 for x, y in zip(p, q)) / (n * (n * n - 1))
            if abs(rho) > 0.9 and not {i, j} & {k for k, _, _ in out}:
                out.append((j, i, pytest.approx(rho)))
    return out


def test_redundant(spark):
    """Sequences with PARTIAL, of unequal lengths, over conditions by name, on two codebases."""
    rng, rows = random.Random(6), []
    values = {"PASS": 1.0, "PARTIAL": 0.5, "FAIL": 0.0}
    for base in "pq":
        for question in range(40):
            first = [rng.choice(list(values)) for _ in range(8)]
            for condition, cut in (("b", 0), ("a-x", 4), ("a", 6)):  # by name, with the comma after it: "a", "a-x", "b"
                for t in range(cut, 8 if condition == "a" else cut + (4 if condition == "b" else 2)):
                    for assertion in (2, 0, 1):
                        if assertion == 1 and t == 7:
                            continue
                        v = first[t] if rng.random() < 0.93 else rng.choice(list(values))
                        rows.append((condition, question, assertion, len(rows), v, base))
    t = spark.createDataFrame(rows, "condition string, question long, assertion long, trial long, verdict string, codebase string")
    got = {}
    for r in E.redundant(E.correlations(E.assertion_rates(t))).collect():
        got.setdefault((r.codebase, r.question), []).append((r.assertion, r.like, r.rho))
    some = 0
    for base in "pq":
        for question in range(40):
            own = [r for r in rows if r[5] == base and r[1] == question]
            lists = [[values[r[4]] for c in sorted(("a-x", "a", "b"), key=lambda c: c + ",") for r in own if r[0] == c and r[2] == a] for a in (2, 0, 1)]
            want = [((2, 0, 1)[j], (2, 0, 1)[i], rho) for j, i, rho in walk(lists)]
            some += bool(want)
            assert sorted(got.get((base, question), [])) == sorted(want, key=lambda w: w[:2])
    assert 5 < some < 80


def test_budget_and_last_codebase(spark):
    rows = [("x", 1, 0, 0, "PASS", "p"), ("y", 1, 0, 1, "PASS", "p"), ("x", 1, 0, 2, "FAIL", "q"), ("y", 1, 1, 3, "PARTIAL", "q")]
    t = spark.createDataFrame(rows, "condition string, question long, assertion long, trial long, verdict string, codebase string")
    cost = spark.createDataFrame([(3.333,)], "cost double")
    # One of the two assertions tells nothing on codebase p.
    assert tuple(E.budget(t, E.diagnostics(t), cost).first()) == (1.67, 0.0, 50)
    assert {(r.condition, r.score) for r in E.last_scores(t).collect()} == {("x", 0.0), ("y", 0.5)}


def test_compare(spark):
    before, after = [0.5, 0.5, 0.5], [0.3, 0.55, 0.9]
    d = E.condition_deltas(E.compare(scores(spark, a=before), scores(spark, a=after))).first()
    assert (d.before, d.after, d.delta, d.regressions, d.improvements) == (0.5, 0.58, 0.08, 1, 1) and d.cliffs_delta == pytest.approx(1 / 3)
    got = {r.question: r.change for r in E.compare(scores(spark, a=[0.5, 0.5, 0.5]), scores(spark, a=[0.3, 0.55, 0.9])).collect()}
    assert got == {0: "regression", 1: "same", 2: "improvement"}


def test_empty(spark):
    t = spark.createDataFrame([], TRIALS)
    assert E.condition_stats(t).count() == 0 and E.cliffs_delta(E.question_scores(t)).count() == 0
    assert E.diagnostics(t).count() == 0 and tuple(E.budget(t, E.diagnostics(t), E.summary(t)).first()) == (0.0, 0.0, 0)
    assert t.agg(F.avg(E.score())).first()[0] is None


def test_diagnostics_find_rates_once(spark):
    # Rates and sequences are read several times: what is returned has no grouping of trials into them.
    t = trials(spark, [(c, q, a, v, 0) for c in ("x", "y") for q in (1, 2) for a in (0, 1) for v in ("PASS", "FAIL", "PASS")])
    plan = E.diagnostics(t, ordered=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev_pop" not in plan
