from kelpline.operators import experiments as E
from kelpline.streaming import results as S

SCHEMA = "condition string, codebase string, question string, assertion string, trial long, verdict string"


def rows(spark, *cells):
    return spark.createDataFrame([("c", "x", q, a, t, v) for q, a, t, v in cells], SCHEMA)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    one, two = rows(spark, ("q", "a", 1, "PASS"), ("q", "b", 1, "FAIL"), ("q", "a", 2, "PASS")), rows(spark, ("q", "a", 3, "FAIL"))
    for batch, epoch in ((one, 0), (two, 1), (one, 0), (two, 1)):
        S.save_batch(batch, epoch, path)
    got = S.recorded(spark, path, one.schema)
    assert sorted((r.assertion, r.trial, r.verdict) for r in got.collect()) == [("a", 1, "PASS"), ("a", 2, "PASS"), ("a", 3, "FAIL"), ("b", 1, "FAIL")]
    assert got.columns and "epoch" not in got.columns


def test_a_trial_sent_again_by_a_later_run_counts_once(spark, tmp_path):
    path = str(tmp_path / "r")
    S.save_batch(rows(spark, ("q", "a", 1, "PASS"), ("q", "b", 1, "PASS")), 4, path)
    S.save_batch(rows(spark, ("q", "a", 1, "FAIL")), 5, path)
    got = S.recorded(spark, path, rows(spark).schema).collect()
    assert [(r.assertion, r.verdict) for r in got] == [("a", "FAIL")]


def test_what_is_done_and_left(spark):
    t = rows(spark, *[("full", "a", i, "PASS" if i % 2 else "FAIL") for i in range(1, 5)], *[("alike", "a", i, "PASS") for i in range(1, 4)], *[("short", "a", i, "PASS") for i in range(1, 3)], *[("mixed", "a", i, v) for i, v in enumerate(("PASS", "FAIL", "PASS"), 1)])
    done = S.finished(t, 4)
    assert {(r.question, r.trials, r.done) for r in done.collect()} == {("full", 4, True), ("alike", 3, True), ("short", 2, False), ("mixed", 3, False)}
    wanted = spark.createDataFrame([(q, "x", "c") for q in ("full", "alike", "short", "mixed", "new")], "question string, codebase string, condition string")
    assert {(r.question, r.first) for r in S.left_over(wanted, done, 4).collect()} == {("short", 3), ("mixed", 4), ("new", 1)}
    assert E.remaining(wanted, done).count() == 3


def test_codebases_stop_apart(spark):
    t = spark.createDataFrame([("c", x, "q", "a", i, v) for x, v in (("x", "PASS"), ("y", "FAIL")) for i in range(3)], SCHEMA)
    assert {(r.codebase, r.done) for r in S.finished(t, 9).collect()} == {("x", True), ("y", True)}


def test_a_stream_that_stops_goes_on(spark, tmp_path):
    src, out, offsets = (str(tmp_path / n) for n in ("src", "out", "offsets"))
    first, second = rows(spark, ("q", "a", 1, "PASS")), rows(spark, ("q", "a", 2, "FAIL"))
    first.write.parquet(src)
    stream = spark.readStream.schema(first.schema).parquet(src)
    S.record(stream, out, offsets)
    second.write.mode("append").parquet(src)
    S.record(stream, out, offsets)
    S.record(stream, out, offsets)
    assert sorted(r.trial for r in S.recorded(spark, out, first.schema).collect()) == [1, 2]
