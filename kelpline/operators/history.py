"""Churn, and files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import grows, in_ranges, kept, spread, tasks_for

HEADER = r"^([0-9a-f]{7,40})\|([^|]*)\|(.+)\z"


#: Pairs of files that one task counts, about.
PAIRS_OF_TASK = 1_000_000

_COMMIT = r"^[0-9a-f]{7,40}\z"


def log_rows(log: DataFrame) -> DataFrame:
    """log (repo, pos, line) of a numstat log as repo, pos, hash, date, msg, added, removed, path; a header's rows follow it.

    A log is read in ranges: each gives its last header, of which a range takes that of the nearest one before it.
    """
    head = F.when(F.col("line").rlike(HEADER), F.struct(*[F.regexp_extract("line", HEADER, i).alias(n) for i, n in ((1, "hash"), (2, "date"), (3, "msg"))]))
    dealt = in_ranges(log, "repo", "pos")
    dealt = spread(dealt, dealt.rdd.getNumPartitions(), "repo", "_range").withColumn("_h", head)
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("repo").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each range of a repository.
    lasts = dealt.groupBy("repo", "_range").agg(F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col("pos"))).alias("_last"))
    lasts = lasts.select("repo", "_range", before.alias("_before"))
    own = F.last("_h", ignorenulls=True).over(Window.partitionBy("repo", "_range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = dealt.join(lasts, ["repo", "_range"]).withColumn("head", F.coalesce(own, "_before")).where(F.col("head").isNotNull() & F.col("line").rlike(r"^\d+\t\d+\t"))
    cut = F.split("line", "\t", 3)
    return rows.select("repo", "pos", "head.*", F.get(cut, 0).cast("long").alias("added"), F.get(cut, 1).cast("long").alias("removed"), F.get(cut, 2).alias("path"))


def log_files(log: DataFrame) -> DataFrame:
    """log (repo, pos, line) of a name-only log as repo, commit_seq, path, distinct; after a blank line that follows files, lines are none until a header.

    A log is read in ranges. Where a commit stands is a state: no file yet, files, or closed. A range
    is a function of the state at its beginning; ranges' functions are composed in order, and every
    range is then read from the state that it begins in.
    """
    dealt = in_ranges(log, "repo", "pos")
    tasks = dealt.rdd.getNumPartitions()
    dealt = spread(dealt, tasks, "repo", "_range").withColumn("_head", F.col("line").rlike(_COMMIT))
    upto = Window.partitionBy("repo", "_range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim("line") == ""
    dealt = dealt.withColumns({"_part": F.sum(F.col("_head").cast("int")).over(upto), "_blank": blank, "_file": ~blank & ~F.col("_head")})
    parts = dealt.groupBy("repo", "_range", "_part").agg(F.min(F.when(F.col("_file"), F.col("pos"))).alias("file"), F.max(F.when(F.col("_blank"), F.col("pos"))).alias("blank"))
    one = F.struct("_part", "file", "blank")
    ranges = parts.groupBy("repo", "_range").agg(F.min(one).alias("first"), F.max(one).alias("last"))
    after = lambda part: F.when(part["file"].isNull(), 0).when(F.coalesce(part["blank"] > part["file"], F.lit(False)), 2).otherwise(1)
    first, last = F.col("first"), F.col("last")
    headless = first["_part"] == 0
    # From no file yet, from files, and how many headers; closed stays closed until a header.
    step = F.struct(
        F.col("_range").alias("range"), last["_part"].alias("heads"), F.when(last["_part"] > 0, after(last)).alias("fixed"),
        F.when(headless, after(first)).otherwise(0).alias("none"), F.when(headless & first["blank"].isNotNull(), 2).otherwise(1).alias("some"),
    )
    begins = "array<struct<range: int, state: int, seq: bigint>>"
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("seq"), F.array().cast(begins).alias("out"))

    def composed(acc, x):
        state = F.coalesce(x["fixed"], F.when(acc["state"] == 0, x["none"]).when(acc["state"] == 1, x["some"]).otherwise(2))
        here = F.struct(x["range"].alias("range"), acc["state"].alias("state"), acc["seq"].alias("seq"))
        return F.struct(state.cast("int").alias("state"), (acc["seq"] + x["heads"]).alias("seq"), F.concat(acc["out"], F.array(here)).alias("out"))

    begun = ranges.groupBy("repo").agg(F.array_sort(F.collect_list(step)).alias("steps")).select("repo", F.explode(F.aggregate("steps", start, composed)["out"]).alias("b"))
    begun = begun.select("repo", F.col("b.range").alias("_range"), F.when(F.col("b.state") == 2, 2).otherwise(F.col("b.state")).alias("_state"), F.col("b.seq").alias("_seq"))
    rows = dealt.join(begun, ["repo", "_range"])
    own = Window.partitionBy("repo", "_range", "_part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.when(F.col("_part") == 0, F.col("_state")).otherwise(0)
    rows = rows.withColumns({"_carried": carried, "commit_seq": (F.col("_seq") + F.col("_part")).cast("long"), "_files": F.sum(F.col("_file").cast("int")).over(own)})
    closed = F.max(F.col("_blank") & ((F.col("_files") > 0) | (F.col("_carried") == 1))).over(own) | (F.col("_carried") == 2)
    found = rows.withColumn("_closed", closed).where("commit_seq > 0 and _file and not _closed").select("repo", "commit_seq", F.trim("line").alias("path"))
    return spread(found, tasks, "repo", "commit_seq").distinct()


def churn(commits: DataFrame, days: int = 30) -> DataFrame:
    """commits (commit, date, message, path, added, removed) of the last days before the newest: path, commits, added, removed and the last commit's last_commit, last_date, last_message."""
    newest = commits.agg(F.max("date")).scalar()
    recent = commits.where(F.col("date") >= newest - F.make_dt_interval(F.lit(days)))
    per = recent.groupBy("path", "commit").agg(F.max("date").alias("date"), F.max("message").alias("message"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    last = F.max(F.struct("date", "commit", "message")).alias("last")
    out = per.groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), last)
    return out.select("path", "commits", "added", "removed", F.col("last.commit").alias("last_commit"), F.col("last.date").alias("last_date"), F.col("last.message").alias("last_message"))


def cochange(commits: DataFrame, links: DataFrame | None = None, most_files: int = 20, least: int = 3) -> DataFrame:
    """Pairs of files: a, b, together, total_a, total_b, confidence, linked.

    Commits of 2 to most_files files count, so that one gives a bounded number of pairs; links (src, dst) are the imports.
    """
    spark, listed = commits.sparkSession, kept(commits.select("commit", "path").where("commit is not null"))
    # Files go by numbers that rise as their paths do, as there are many more pairs than files.
    names = listed.select("path").where("path is not null").distinct().repartitionByRange("path").sortWithinPartitions("path")
    names = kept(names.withColumn("n", F.monotonically_increasing_id()))
    numbered = listed.join(grows(names), "path", "left").select("commit", "n").repartition(tasks_for(spark, listed.count()), "commit").distinct()
    # Counted before they are listed: a commit may have any number of files.
    few = numbered.withColumn("_files", F.count(F.lit(1)).over(Window.partitionBy("commit"))).where(F.col("_files").between(2, most_files))
    files = kept(few.groupBy("commit").agg(F.array_sort(F.collect_list("n")).alias("p")))
    n = files.agg(F.coalesce(F.sum(F.size("p") * (F.size("p") - 1) / 2), F.lit(0.0)).cast("long")).first()[0]
    each = F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, most_files), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    # Where they are many, few repeat within a task: they are dealt before they are counted, to tasks whose number grows with theirs.
    dealt = files.select(F.explode(F.flatten(each)).alias("x")).select("x.a", "x.b")
    dealt = spread(dealt, tasks_for(spark, n, PAIRS_OF_TASK), "a", "b")
    pairs = kept(dealt.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= least))
    totals = files.select(F.explode("p").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("total")).join(grows(names), "n")
    of = lambda c: totals.select(F.col("n").alias(f"_{c}"), F.col("path").alias(c), F.col("total").alias(f"total_{c}"))
    pairs, tasks = pairs.withColumnsRenamed({"a": "_a", "b": "_b"}), tasks_for(spark, pairs.count())
    out = spread(pairs, tasks, "_a").join(of("a"), "_a")
    out = spread(out, tasks, "_b").join(of("b"), "_b").select("a", "b", "together", "total_a", "total_b")
    out = out.withColumn("confidence", F.col("together") / F.least("total_a", "total_b"))
    if links is None:
        return out.withColumn("linked", F.lit(False))
    known = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    tasks = tasks_for(spark, known.count())
    known = spread(known, tasks, "a", "b").distinct().withColumn("linked", F.lit(True))
    return out.join(known, ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def top_pairs(pairs: DataFrame, top: int = 8) -> DataFrame:
    return pairs.orderBy("linked", F.desc(F.col("confidence") * F.col("together")), "a", "b").limit(top)
