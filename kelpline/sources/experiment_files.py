"""Configurations and results of evaluation experiments, as JSON files that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The files' fields, and what a configuration leaves out.
CONFIG = "name string, codebases array<struct<id: string, path: string>>, conditions array<struct<id: string, name: string, encoding: string>>, questions array<struct<id: string, text: string, taskType: string, assertions: array<string>>>, trials int, maxTokens int, delayMs int"
RESULTS = "config struct<name: string, timestamp: string, codebases: array<string>>, results array<struct<questionId: string, question: string, taskType: string, codebaseName: string, conditions: array<struct<conditionId: string, conditionName: string, aggregateScore: double, trials: array<struct<trial: int, response: string, tokens: struct<input: bigint, output: bigint>, latencyMs: double, stopReason: string, toolCallCount: int, scores: array<struct<assertion: string, verdict: string, reasoning: string>>>>>>>>"
DEFAULTS = {"trials": 3, "maxTokens": 1024, "delayMs": 600}
REWRITE = r'REWRITE:\s*\[(\S+)\]\s*"([^"]+)"\s*\nPROBLEM:\s*(.+)\s*\nNEW:\s*"([^"]+)"\s*\nWHY:\s*(.+)'


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Configurations with their defaults; one that lacks a name, codebases, conditions or questions raises an error."""
    rows = spark.read.schema(CONFIG).option("multiLine", True).json(path)
    bad = F.col("name").isNull() | (F.col("name") == "")
    for c in ("codebases", "conditions", "questions"):
        bad = bad | (F.coalesce(F.size(c), F.lit(0)) <= 0)
    name = F.when(bad, F.raise_error(F.lit("a configuration needs name, codebases, conditions and questions")).cast("string")).otherwise(F.col("name"))
    return rows.withColumn("name", name).withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items()})


def questions(config: DataFrame) -> DataFrame:
    return config.select(F.explode("questions").alias("q")).select(F.col("q.id").alias("question"), F.col("q.text").alias("text"), F.col("q.taskType").alias("task_type"), F.col("q.assertions").alias("assertions"))


def wanted(config: DataFrame) -> DataFrame:
    """question, codebase, condition of all that a configuration asks for."""
    each = config.select(F.explode("questions.id").alias("question"), F.col("codebases.id").alias("c"), F.col("conditions.id").alias("k"))
    return each.select("question", F.explode("c").alias("codebase"), "k").select("question", "codebase", F.explode("k").alias("condition"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results as rows: run, question, task_type, codebase, condition, condition_name, trial, tokens_in, tokens_out, latency, tools, assertion, verdict, reasoning.

    Read a line at a time where a file has one result in each line, so that large ones are split.
    """
    return flattened(spark.read.schema(RESULTS).json(path))


def flattened(runs: DataFrame) -> DataFrame:
    q = runs.select(F.col("config.name").alias("run"), F.explode("results").alias("q")).select("run", "q.*")
    c = q.select("run", F.col("questionId").alias("question"), F.col("taskType").alias("task_type"), F.col("codebaseName").alias("codebase"), F.explode("conditions").alias("c"))
    t = c.select("run", "question", "task_type", "codebase", F.col("c.conditionId").alias("condition"), F.col("c.conditionName").alias("condition_name"), F.explode("c.trials").alias("t"))
    s = t.select("run", "question", "task_type", "codebase", "condition", "condition_name", F.col("t.trial").alias("trial"), F.col("t.tokens.input").alias("tokens_in"), F.col("t.tokens.output").alias("tokens_out"), F.col("t.latencyMs").alias("latency"), F.col("t.toolCallCount").alias("tools"), F.explode_outer("t.scores").alias("s"))
    return s.select(*s.columns[:-1], F.col("s.assertion").alias("assertion"), F.col("s.verdict").alias("verdict"), F.col("s.reasoning").alias("reasoning"))


def nested(rows: DataFrame) -> DataFrame:
    """flattened() undone: a line of results for each run, question and codebase."""
    key = ["run", "question", "task_type", "codebase", "condition", "condition_name"]
    trial = rows.groupBy(*key, "trial", "tokens_in", "tokens_out", "latency", "tools").agg(F.array_sort(F.collect_list(F.struct("assertion", "verdict", "reasoning"))).alias("scores"))
    one = F.struct(F.col("trial"), F.lit(None).cast("string").alias("response"), F.struct(F.col("tokens_in").alias("input"), F.col("tokens_out").alias("output")).alias("tokens"), F.col("latency").alias("latencyMs"), F.lit(None).cast("string").alias("stopReason"), F.col("tools").alias("toolCallCount"), "scores")
    worth = F.transform("scores", lambda s: F.when(s["verdict"] == "PASS", 1.0).when(s["verdict"] == "PARTIAL", 0.5).otherwise(0.0))
    trial = trial.withColumn("_score", F.try_divide(F.aggregate(worth, F.lit(0.0), lambda a, x: a + x), F.size("scores")))
    cond = trial.groupBy(*key).agg(F.coalesce(F.avg("_score"), F.lit(0.0)).alias("aggregateScore"), F.array_sort(F.collect_list(one)).alias("trials"))
    cond = cond.groupBy(*key[:4]).agg(F.array_sort(F.collect_list(F.struct(F.col("condition").alias("conditionId"), F.col("condition_name").alias("conditionName"), "aggregateScore", "trials"))).alias("conditions"))
    q = F.struct(F.col("question").cast("string").alias("questionId"), F.lit(None).cast("string").alias("question"), F.col("task_type").alias("taskType"), F.col("codebase").alias("codebaseName"), "conditions")
    return cond.select(F.struct(F.col("run").alias("name")).alias("config"), F.array(q).alias("results"))


def write_results(rows: DataFrame, path: str) -> None:
    nested(rows).write.mode("append").json(path)


def save_checkpoint(done: DataFrame, path: str) -> None:
    """Adds question, codebase, condition, done to the run's checkpoint; done says that no trial is missing or that it stopped early."""
    done.select("question", "codebase", "condition", "done").write.mode("append").parquet(path)


def advice(text: Column) -> Column:
    """struct(rewrites, conditions, questions, savings) of an adviser's reply."""
    group = lambda i: F.regexp_extract_all(text, F.lit(REWRITE), F.lit(i))
    rewrites = F.transform(F.arrays_zip(group(1).alias("question"), group(2).alias("assertion"), group(3).alias("problem"), group(4).alias("rewrite"), group(5).alias("why")), lambda r: F.struct(r["question"].alias("question"), r["assertion"].alias("assertion"), F.trim(r["problem"]).alias("problem"), r["rewrite"].alias("rewrite"), F.trim(r["why"]).alias("why")))
    lines = F.split(text, "\n", -1)
    of = lambda k: F.transform(F.filter(lines, lambda x: x.startswith(f"{k}:")), lambda x: F.trim(F.substring(x, len(k) + 2, 1 << 30)))
    return F.struct(rewrites.alias("rewrites"), of("CONDITION").alias("conditions"), of("QUESTION").alias("questions"), F.coalesce(F.try_element_at(of("SAVINGS"), F.lit(-1)), F.lit("")).alias("savings"))
