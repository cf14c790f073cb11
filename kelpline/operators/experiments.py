"""Statistics of evaluation experiments: trials are rows (condition, question, assertion, trial, verdict, latency, tools, tokens_in, tokens_out; codebase and condition_name if there are several).

Trials rise in the order they came. Where conditions have an order, it is that in which they are first seen.
A result is that of a question on a codebase; diagnostics look at each result apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import kept, row_numbers
from ..functions import draws
from ..functions.columns import round2
from ..functions.render import fixed, plain_number


def score():
    return F.when(F.col("verdict") == "PASS", 1.0).when(F.col("verdict") == "PARTIAL", 0.5).otherwise(0.0)


def result_keys(trials: DataFrame) -> list[str]:
    return [c for c in ("codebase", "question") if c in trials.columns]


def question_scores(trials: DataFrame) -> DataFrame:
    """condition, question, codebase if there is one, score, ord (the first trial); a row for each result and condition."""
    return trials.groupBy("condition", *reversed(result_keys(trials))).agg(F.avg(score()).alias("score"), F.min("trial").alias("ord"))


def condition_stats(trials: DataFrame) -> DataFrame:
    """Of the questions' scores: mean, population deviation, least and most; of the verdicts: shares; mean latency and tokens."""
    per = question_scores(trials).groupBy("condition").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("deviation"), F.min("score").alias("least"), F.max("score").alias("most"))
    share = lambda v: F.avg((F.col("verdict") == v).cast("double"))
    all_ = trials.groupBy("condition").agg(share("PASS").alias("passed"), share("PARTIAL").alias("partial"), share("FAIL").alias("failed"), F.avg("latency").alias("latency"), F.avg(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"))
    return per.join(all_, "condition")


def _pairs(scores: DataFrame) -> DataFrame:
    """Pairs of conditions (few: one for each arm of an experiment), the one that is first seen first."""
    names = scores.groupBy("condition").agg(F.min("ord").alias("_k"))
    of = lambda n: names.select(F.col("condition").alias(n), F.struct("_k", "condition").alias(f"_{n}"))
    return of("a").join(of("b"), F.col("_a") < F.col("_b")).select("a", "b")


def _deltas(values: DataFrame, *by: str) -> DataFrame:
    """by, delta over all pairs of values of two sides, from counts of distinct values rather than the pairs: values has by, score, na, nb."""
    both = values.groupBy(*by, "score").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    before = F.coalesce(F.sum("nb").over(Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = both.withColumns({"_below": before, "_all": F.sum("nb").over(Window.partitionBy(*by))})
    return rows.groupBy(*by).agg((F.sum(F.col("na") * (F.col("_below") - (F.col("_all") - F.col("_below") - F.col("nb")))) / (F.sum("na") * F.max("_all"))).alias("delta"))


def cliffs_delta(scores: DataFrame) -> DataFrame:
    """a, b, delta, magnitude of the scores of two conditions."""
    v = scores.groupBy("condition", "score").agg(F.count(F.lit(1)).alias("n"))
    p, none = _pairs(scores), F.lit(0).cast("long")
    one = p.join(v, F.col("a") == F.col("condition")).select("a", "b", "score", F.col("n").alias("na"), none.alias("nb"))
    two = p.join(v, F.col("b") == F.col("condition")).select("a", "b", "score", none.alias("na"), F.col("n").alias("nb"))
    rows, size = _deltas(one.unionByName(two), "a", "b"), F.abs("delta")
    return rows.withColumn("magnitude", F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large"))


def win_rates(scores: DataFrame, tie: float = 0.01) -> DataFrame:
    """a, b, wins, losses, ties, total: the conditions' questions are matched in the order they came, up to the end of the shorter list."""
    placed = row_numbers(scores.select("condition", "score", "ord", "question"), ["condition"], ["ord", "question"]).select("condition", "score", "place")
    left = placed.select(F.col("condition").alias("a"), "place", F.col("score").alias("x"))
    right = placed.select(F.col("condition").alias("b"), "place", F.col("score").alias("y"))
    gap = F.col("x") - F.col("y")
    rows = left.join(_pairs(scores), "a").join(right, ["b", "place"])
    even = F.abs(gap) < tie
    return rows.groupBy("a", "b").agg(F.count_if(~even & (gap > 0)).alias("wins"), F.count_if(~even & (gap < 0)).alias("losses"), F.count_if(even).alias("ties"), F.count(F.lit(1)).alias("total"))


#: Resamples that one task draws at a time, places of a piece, pieces of a block (all that a task holds of a condition).
RESAMPLES, PIECE, BLOCK = 100, 1 << 16, 64


def _picked(key: tuple[pa.Scalar, ...], pieces: pa.Table, most: int) -> pa.Table:
    """How often each score of a block of so many places at most is drawn, for each of a cell's resamples."""
    a, b, side, first, last, n, block = (k.as_py() for k in key)
    pieces = pieces.sort_by("piece").column("scores").combine_chunks()
    values, codes = np.unique(pieces.flatten().to_numpy(), return_inverse=True)
    begin, out = block * most, []
    for tile in draws.tiles(n):
        made = draws.Draws(*tile)
        for i in range(first, last):
            place = made.heads(f"{a}|{b}|{i}|{side}|".encode()) % np.int64(n) - begin
            if n > len(codes):
                place = place[(place >= 0) & (place < len(codes))]
            times = np.bincount(codes[place], minlength=len(values))
            some = np.flatnonzero(times)
            out.append((np.full(len(some), i), values[some], times[some]))
    i, score, times = (np.concatenate([o[k] for o in out]) for k in range(3))  # n is 1 at least
    own, none = pa.array(times, pa.int64()), pa.array(np.zeros(len(times), np.int64))
    text = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(times), np.int64)))
    na, nb = (own, none) if side == "a" else (none, own)
    return pa.table([text(a), text(b), pa.array(i, pa.int32()), pa.array(score), na, nb], names=["a", "b", "i", "score", "na", "nb"])


def bootstrap(scores: DataFrame, times: int = 1000, alpha: float = 0.05, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """a, b, lo, hi: Cliff's delta of resampled scores, its order statistics at alpha / 2 and 1 - alpha / 2, to two decimals.

    A draw is a number from 1 to n by the first 32 bits of the MD5 of a|b|resample|side|draw, so any
    engine draws the same, and what is lost is drawn alike again. A cell of RESAMPLES resamples of a
    side makes its draws and looks their scores up in a block of the condition's scores, block *
    piece places at most; where a condition has several blocks, each is a cell that makes the draws
    again. Only counts of scores are shuffled, and no draws.
    """
    order = ["ord", *result_keys(scores)]
    placed = kept(row_numbers(scores.select("condition", "score", *order), ["condition"], order).select("condition", "place", "score"))
    sizes = placed.groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    one = F.array_sort(F.collect_list(F.struct("place", F.col("score").cast("double").alias("score"))))
    number = F.floor((F.col("place") - 1) / piece).cast("int").alias("piece")
    pieces = placed.groupBy("condition", number).agg(F.transform(one, lambda x: x["score"]).alias("scores")).withColumn("block", F.floor(F.col("piece") / block).cast("int"))
    of = lambda side: F.struct(F.lit(side).alias("side"), F.col(side).alias("condition"))
    sides = _pairs(scores).select("a", "b", F.explode(F.array(of("a"), of("b"))).alias("s")).select("a", "b", "s.*").join(sizes, "condition")
    cells = sides.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(times - 1), F.lit(RESAMPLES)))).withColumn("last", F.least(F.col("first") + RESAMPLES, F.lit(times)))
    # Few rows that take long: each cell is dealt by its number, and adaptive execution doesn't merge tasks by their small size.
    tasks = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.join(kept(pieces), "condition").repartition(tasks, "a", "b", "side", "first", "last", "n", "block")
    counted = rows.groupBy("a", "b", "side", "first", "last", "n", "block").applyInArrow(lambda key, table: _picked(key, table, piece * block), "a string, b string, i int, score double, na long, nb long")
    found = _deltas(counted, "a", "b", "i")
    ranked = found.withColumn("_k", F.row_number().over(Window.partitionBy("a", "b").orderBy("delta", "i")) - 1)
    at = lambda share: round2(F.max(F.when(F.col("_k") == int(share * times), F.col("delta"))))
    return ranked.groupBy("a", "b").agg(at(alpha / 2).alias("lo"), at(1 - alpha / 2).alias("hi"))


def sampled(trials: DataFrame, n: int) -> DataFrame:
    """So many rows of trials by chance: those whose trial and assertion have the smallest MD5."""
    return trials.orderBy(F.md5(F.concat_ws("|", F.col("trial").cast("string"), F.col("assertion").cast("string")).cast("binary")), "trial", "assertion").limit(n)


def assertion_rates(trials: DataFrame) -> DataFrame:
    """Of each result's assertion in each condition: rate (mean score), passed (share of PASS), n, cv (deviation over mean, 0 for a mean of 0), verdicts (scores in the order of trials), ord (the first trial), seen (the first trial of the condition in the result)."""
    keys = result_keys(trials)
    one = F.struct("trial", score().alias("s"))
    per = trials.groupBy(*keys, "assertion", "condition").agg(
        F.avg(score()).alias("rate"), F.avg((F.col("verdict") == "PASS").cast("double")).alias("passed"), F.stddev_pop(score()).alias("_d"), F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("verdicts"), F.min("trial").alias("ord"),
    )
    per = per.withColumn("cv", F.when(F.col("rate") == 0, 0.0).otherwise(F.col("_d") / F.col("rate"))).drop("_d")
    return per.withColumn("seen", F.min("ord").over(Window.partitionBy(*keys, "condition")))


def non_discriminating(rates: DataFrame, least: float = 0.05) -> DataFrame:
    """Assertions whose shares of PASS differ by less than least over the conditions; passed is their mean."""
    per = rates.groupBy(*result_keys(rates), "assertion").agg(F.count(F.lit(1)).alias("conditions"), (F.max("passed") - F.min("passed")).alias("spread"), F.avg("passed").alias("passed"))
    return per.where((F.col("conditions") >= 2) & (F.col("spread") < least))


def flaky(rates: DataFrame, above: float = 0.3) -> DataFrame:
    """Assertions whose scores vary so in a condition that has 3 or more; the condition that is seen first is told."""
    bad, keys = rates.where((F.col("n") >= 3) & (F.col("cv") > above)), result_keys(rates)
    return bad.groupBy(*keys, "assertion").agg(F.min(F.struct("seen", "condition", "cv")).alias("f")).select(*keys, "assertion", "f.condition", "f.cv")


def negative(trials: DataFrame, by: float = 0.05) -> DataFrame:
    """keys, worse, better, worse_score, better_score: conditions with full in their name that score lower, over a result, than one without it."""
    keys = result_keys(trials)
    name = "condition_name" if "condition_name" in trials.columns else "condition"
    per = trials.groupBy(*keys, "condition", F.col(name).alias("name")).agg(F.avg(score()).alias("score"))
    full = F.lower("name").contains("full")
    worse = per.where(full).select(*keys, F.col("name").alias("worse"), F.col("score").alias("worse_score"))
    better = per.where(~full).select(*keys, F.col("name").alias("better"), F.col("score").alias("better_score"))
    return worse.join(better, keys).where(F.col("better_score") - F.col("worse_score") > by)


def sequences(rates: DataFrame) -> DataFrame:
    """keys, assertion, place (from 0, as first seen in the result), v: an assertion's scores, conditions by name and trials in order."""
    keys = result_keys(rates)
    # Names are compared with what follows them in a list, a comma.
    one = F.struct(F.concat("condition", F.lit(",")).alias("c"), F.col("verdicts").alias("v"))
    per = rates.groupBy(*keys, "assertion").agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"])).alias("v"), F.min(F.struct("seen", "ord")).alias("_first"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_first", "assertion")) - 1).drop("_first")


def _ranks(v):
    """Ranks from 1 of the scores in an array, the mean where several are equal; there are three scores."""
    less = lambda x: F.size(F.filter(v, lambda y: y < x))
    same = lambda x: F.size(F.filter(v, lambda y: y == x))
    low, mid, high = (F.lit(x) for x in (0.0, 0.5, 1.0))
    rank = lambda x: less(x) + (same(x) + 1) / 2
    of = F.struct(rank(low).alias("l"), rank(mid).alias("m"), rank(high).alias("h"))
    return of, lambda ranks: F.transform(v, lambda x: F.when(x == low, ranks["l"]).when(x == mid, ranks["m"]).otherwise(ranks["h"]))


def correlations(rates: DataFrame) -> DataFrame:
    """keys, x, y, i, j, rho of two assertions' sequences, cut to the shorter; x is seen first (i, j: places). No correction for ties; under 3 scores give 0."""
    return sequence_correlations(sequences(rates))


def sequence_correlations(seq: DataFrame) -> DataFrame:
    """As correlations(), of sequences()."""
    keys = result_keys(seq)
    left = seq.select(*keys, F.col("assertion").alias("x"), F.col("place").alias("i"), F.col("v").alias("a"))
    right = seq.select(*keys, F.col("assertion").alias("y"), F.col("place").alias("j"), F.col("v").alias("b"))
    both = left.join(right, keys).where("i < j").withColumn("n", F.least(F.size("a"), F.size("b")))
    both = both.withColumns({"a": F.slice("a", 1, F.col("n")), "b": F.slice("b", 1, F.col("n"))})
    (rank_a, as_a), (rank_b, as_b) = _ranks(F.col("a")), _ranks(F.col("b"))
    both = both.withColumns({"_a": rank_a, "_b": rank_b})
    squares = F.zip_with(as_a(F.col("_a")), as_b(F.col("_b")), lambda p, q: (p - q) * (p - q))
    both = both.withColumn("_d", F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))
    n = F.col("n").cast("double")
    return both.select(*keys, "x", "y", "i", "j", F.when(n < 3, 0.0).otherwise(1 - 6 * F.col("_d") / (n * (n * n - 1))).alias("rho"))


def redundant(found: DataFrame, above: float = 0.9) -> DataFrame:
    """keys, assertion, like, rho: assertions that repeat an earlier one that isn't flagged itself (greedy, in the order seen; a result has few assertions)."""
    keys, type_ = result_keys(found), dict(found.dtypes)["x"]
    kind = f"array<struct<assertion: {type_}, like: {type_}, rho: double>>"
    pairs = found.where(F.abs("rho") > above).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j", "x", "y", "rho"))).alias("p"))
    flagged = lambda acc, x: F.exists(acc, lambda f: f["assertion"] == x)
    one = lambda p: F.struct(p["y"].alias("assertion"), p["x"].alias("like"), p["rho"].alias("rho"))
    greedy = F.aggregate("p", F.array().cast(kind), lambda acc, p: F.when(flagged(acc, p["x"]) | flagged(acc, p["y"]), acc).otherwise(F.concat(acc, F.array(one(p)))))
    return pairs.select(*keys, F.explode(greedy).alias("f")).select(*keys, "f.assertion", "f.like", "f.rho")


def diagnostics(trials: DataFrame, ordered: bool = False) -> DataFrame:
    """keys, kind, assertion (text), detail: all that is wrong with results' assertions, with what a report says of it; kinds: non-discriminating, flaky, redundant, negative-signal (where the assertion names two conditions).

    ordered: with first, second, by which a report orders a kind in a result: places of assertions, or how much scores are below 1.
    """
    # Both are read several times, and are found once.
    rates, keys = kept(assertion_rates(trials)), result_keys(trials)
    seq = kept(sequences(rates))
    text = lambda c: F.col(c).cast("string")
    mean = F.when(F.col("passed") > 0.95, "PASS").when(F.col("passed") < 0.05, "FAIL").otherwise(F.concat(fixed(F.col("passed") * 100, 0), F.lit("%")))
    signed = F.concat(F.when(F.col("rho") < 0, "-").otherwise(""), fixed(F.abs("rho"), 2))
    flak = flaky(rates).join(rates.select(*keys, "assertion", "condition", "verdicts"), [*keys, "assertion", "condition"])
    same, twice, worse = non_discriminating(rates), redundant(sequence_correlations(seq)), negative(trials)
    order = []
    if ordered:
        order, none = ["first", "second"], F.lit(0.0)
        places = seq.select(*keys, "assertion", F.col("place").cast("double").alias("first"))
        same, flak = (df.join(places, [*keys, "assertion"]).withColumn("second", none) for df in (same, flak))
        twice = twice.join(places.withColumnRenamed("first", "second"), [*keys, "assertion"]).join(places.withColumnRenamed("assertion", "like"), [*keys, "like"])
        worse = worse.withColumns({"first": 1 - F.col("better_score"), "second": 1 - F.col("worse_score")})
    found = {
        "non-discriminating": same.select(*keys, *order, text("assertion").alias("assertion"), F.concat(mean, F.lit(" across all conditions (max diff "), fixed(F.col("spread") * 100, 1), F.lit("%)")).alias("detail")),
        "flaky": flak.select(*keys, *order, text("assertion").alias("assertion"), F.concat(F.lit("CV="), fixed(F.col("cv"), 2), F.lit(" in condition "), "condition", F.lit(" (trials: "), F.array_join(F.transform("verdicts", plain_number), ", "), F.lit(")")).alias("detail")),
        "redundant": twice.select(*keys, *order, text("assertion").alias("assertion"), F.concat(F.lit("Spearman rho="), signed, F.lit(' with "'), text("like"), F.lit('"')).alias("detail")),
        "negative-signal": worse.select(*keys, *order, F.concat("worse", F.lit(" vs "), "better").alias("assertion"), F.concat(F.lit('"'), "worse", F.lit('" ('), fixed(F.col("worse_score"), 2), F.lit(') scores lower than "'), "better", F.lit('" ('), fixed(F.col("better_score"), 2), F.lit(")")).alias("detail")),
    }
    parts = [df.select(*keys, F.lit(k).alias("kind"), "assertion", "detail", *order) for k, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tool_usage(trials: DataFrame) -> DataFrame:
    """Per condition: tools a trial uses in the mean, the share of trials without one, and their number."""
    each = trials.where("tools is not null").groupBy("condition", *result_keys(trials), "trial").agg(F.max("tools").alias("tools"))
    return each.groupBy("condition").agg(F.avg("tools").alias("mean_tools"), F.avg((F.col("tools") == 0).cast("double")).alias("none"), F.count(F.lit(1)).alias("trials"))


def early_stop(trials: DataFrame, least: int = 3) -> DataFrame:
    """condition, question, n of those with least trials or more that all have one list of verdicts, by assertion."""
    each = trials.groupBy("condition", "question", "trial").agg(F.array_sort(F.collect_list(F.struct("assertion", "verdict"))).alias("v")).withColumn("v", F.array_join(F.transform("v", lambda x: x["verdict"]), ","))
    per = each.groupBy("condition", "question").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return per.where((F.col("n") >= least) & (F.col("lo") == F.col("hi"))).select("condition", "question", "n")


def summary(trials: DataFrame, per_million_in: float = 3.0, per_million_out: float = 15.0) -> DataFrame:
    """One row: calls, tokens_in, tokens_out, cost."""
    each = trials.groupBy("condition", "question", "trial").agg(F.max("tokens_in").alias("i"), F.max("tokens_out").alias("o"))
    s = each.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("i"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("o"), F.lit(0)).alias("tokens_out"))
    return s.withColumn("cost", F.col("tokens_in") / 1e6 * per_million_in + F.col("tokens_out") / 1e6 * per_million_out)


def task_types(questions: DataFrame) -> DataFrame:
    return questions.select("task_type").distinct().orderBy("task_type")


def by_task(trials: DataFrame, conditions: list[str], task: str = "task_type") -> DataFrame:
    """Per task: each condition's mean score in a column of its name."""
    return trials.groupBy(task).pivot("condition", conditions).agg(F.avg(score()))


def remaining(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run has still to do: wanted (question, codebase, condition) without the keys of done that are marked as done, early stops too."""
    return wanted.join(done.where("done").select("question", "codebase", "condition").distinct(), ["question", "codebase", "condition"], "left_anti")


def with_questions(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Results of questions that the configuration has, with the question's text and task type."""
    return results.join(questions.select("question", "text", "task_type"), "question")


def last_scores(trials: DataFrame) -> DataFrame:
    """condition, question, score, ord: of a question's results on several codebases, the last one's."""
    return question_scores(trials).groupBy("condition", "question").agg(F.max_by("score", "ord").alias("score"), F.max("ord").alias("ord"))


def compare(before: DataFrame, after: DataFrame, by: float = 0.1) -> DataFrame:
    """condition, question, before, after, delta, change of two runs' scores, where both have the question."""
    of = lambda df, name: df.select("condition", "question", F.col("score").alias(name))
    rows = of(before, "before").join(of(after, "after"), ["condition", "question"]).withColumn("delta", F.col("after") - F.col("before"))
    return rows.withColumn("change", F.when(F.col("delta") < -by, "regression").when(F.col("delta") > by, "improvement").otherwise("same"))


def condition_deltas(compared: DataFrame) -> DataFrame:
    """Per condition of compare(): mean before and after and their difference, to two decimals, Cliff's delta of after against before, and how many of its questions went down or up."""
    count = lambda x: F.count_if(F.col("change") == x)
    means = compared.groupBy("condition").agg(F.avg("before").alias("_b"), F.avg("after").alias("_a"), count("regression").alias("regressions"), count("improvement").alias("improvements"), F.count(F.lit(1)).alias("questions"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = compared.select("condition", F.col("after").alias("score"), one.alias("na"), none.alias("nb")).union(compared.select("condition", "before", none, one))
    both = means.join(_deltas(sides, "condition").withColumnRenamed("delta", "cliffs_delta"), "condition")
    return both.select("condition", round2(F.col("_b")).alias("before"), round2(F.col("_a")).alias("after"), round2(F.col("_a") - F.col("_b")).alias("delta"), "cliffs_delta", "regressions", "improvements", "questions")


def iteration_costs(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: cost_before, cost_after of two runs' trials."""
    return summary(before).select(F.col("cost").alias("cost_before")).crossJoin(summary(after).select(F.col("cost").alias("cost_after")))


def consistency(trials: DataFrame) -> DataFrame:
    """Per condition: the share of (question, assertion) with one verdict, and the share of PARTIAL verdicts."""
    per = trials.groupBy("condition", "question", "assertion").agg(F.countDistinct("verdict").alias("k"))
    same = per.groupBy("condition").agg(F.avg((F.col("k") == 1).cast("double")).alias("consistent"))
    part = trials.groupBy("condition").agg(F.avg((F.col("verdict") == "PARTIAL").cast("double")).alias("partial"))
    return same.join(part, "condition").withColumn("biased", F.col("partial") < 0.05)


def budget(trials: DataFrame, found: DataFrame, cost: DataFrame) -> DataFrame:
    """One row: what of the cost (one row) assertions of diagnostics() took that tell nothing or repeat others, to two decimals, and their share of it in whole percents.

    Assertions are counted by question; where there are none, those found and one more stand for them.
    """
    count = lambda k: F.count_if(F.col("kind") == k)
    n = trials.select("question", "assertion").distinct().agg(F.count(F.lit(1)).alias("_n"))
    of = n.crossJoin(found.agg(count("non-discriminating").alias("_w"), count("redundant").alias("_r"))).crossJoin(cost.select("cost"))
    total = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_w") + F.col("_r") + 1)
    wasted, again = F.col("_w") / total * F.col("cost"), F.col("_r") / total * F.col("cost")
    percent = F.when(F.col("cost") > 0, F.floor((wasted + again) / F.col("cost") * 100 + 0.5)).otherwise(0)
    return of.select(round2(wasted).alias("wasted_on_non_discriminating"), round2(again).alias("recoverable_from_redundant"), percent.cast("long").alias("savings_percent"))
