"""Quality rules at host level, in DataFrame functions only.

Each document is held against document rules; failures are counted by host; each host's
failure rate is shrunk towards a beta prior fitted to all hosts by the method of moments;
a host whose shrunk rate is too high takes all its documents with it.

Defined results: a null text has no words; a null host is the host ''; an empty table
gives an empty table; rows that repeat are judged one by one; columns other than those
named are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, pick, settled, table, written

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A host goes when its shrunk failure rate is above this.
HOST_LIMIT = 0.6
#: The prior weighs as many documents as this at least and at most.
PRIOR_LEAST, PRIOR_MOST = 2.0, 1000.0


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with FEATURES (long) of the whole text, each in time n log n of its length at most."""
    at = lambda i: F.get("_words", i)
    same = lambda a, b: (a["h"] == b["h"]) & (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.filter(F.split(body, f"{SPACE_CLASS}+"), lambda w: w != ""))
    starts = F.sequence(F.lit(0), F.size("_words") - 3)
    out = out.withColumn("_hashes", F.when(F.size("_words") >= 3, F.sort_array(F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))))
    out = out.withColumn("_again", F.size(F.filter("_hashes", lambda h, k: h == F.get("_hashes", k + 1))) > 0)
    # Where hashes meet, equal 3-word windows do when sorted; the hash goes first so that words are seldom compared.
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.alias("i"))))
    out = out.withColumn("_windows", F.when(F.col("_again"), windows).otherwise(F.array()))
    out = out.withColumn("_found", F.filter("_windows", lambda w, k: F.coalesce(same(w, F.get("_windows", k - 1)), F.lit(False)) | F.coalesce(same(w, F.get("_windows", k + 1)), F.lit(False))))
    out = out.withColumn("_found", F.sort_array(F.transform("_found", lambda w: w["i"])))
    # A found window adds the words after the end of the one before it, 3 at most.
    fresh = F.transform("_found", lambda i, k: F.least(F.lit(3), F.coalesce(i - F.get("_found", k - 1), F.lit(3))))
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    out = out.withColumn("_lines", lines)
    return out.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(fresh, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failed():
    """What counts against a document's host: a base rule, mean word length, symbols or repeated lines."""
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return base_failed() | (mean < 2) | (mean > 15) | (2 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > F.col("n_words"))


def host_rates(features: DataFrame, host: str = "source") -> DataFrame:
    """Per host: host, host_docs, host_fails (long), host_rate (double, shrunk), host_kept (boolean).

    The prior's mean m is the failure rate over all hosts, its weight m(1 - m) / v - 1 with v
    the variance of the hosts' own rates less what chance alone gives them, m(1 - m) times the
    mean of 1 / host_docs, held within PRIOR_LEAST and PRIOR_MOST.
    """
    per = features.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(rule_failed().cast("long")).alias("host_fails"))
    per = settled(per)
    m = F.sum("host_fails") / F.sum("host_docs")
    prior = per.agg(m.alias("m"), F.var_pop(F.col("host_fails") / F.col("host_docs")).alias("all"), F.avg(1 / F.col("host_docs")).alias("chance"))
    prior = prior.withColumn("v", F.col("all") - F.col("m") * (1 - F.col("m")) * F.col("chance"))
    weight = F.greatest(F.lit(PRIOR_LEAST), F.least(F.lit(PRIOR_MOST), F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(PRIOR_MOST)))
    prior = prior.select("m", weight.alias("w"))
    m, w = prior.select("m").scalar(), prior.select("w").scalar()
    rate = (F.col("host_fails") + m * w) / (F.col("host_docs") + w)
    return per.select("host", "host_docs", "host_fails", rate.alias("host_rate")).withColumn("host_kept", F.col("host_rate") <= HOST_LIMIT)


def judge(features: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """features with base_failed, the host's columns and kept; hosts come as host_rates() returns them."""
    keyed = features.withColumn("host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    return keyed.withColumn("base_failed", base_failed()).join(hosts, "host", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    # Counts alone are kept, so that texts are gone through once for hosts and documents.
    found = settled(with_features(docs).drop("text"))
    return judge(found, host_rates(found)).select("doc_id", *FEATURES, "base_failed", "kept", "host", "host_docs", "host_fails", F.round("host_rate", 9).alias("host_rate"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, as they came."""
    docs = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    # Kept with their texts, so that counting is done once: a filter or sum above it would be merged into it and count again for each use.
    found = written(with_features(docs), "features")
    return judge(found, host_rates(found)).where("kept").select(*docs.columns)


#: The same constants as above stand in for the rules and the prior.
OP2_SQL = rf"""
with w as (
  select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
words as (
  select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from w),
tri as (
  select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k
  from (select r, ws, unnest(generate_series(1, len(ws) - 2)) as i from words where len(ws) >= 3)),
rep as (select r, i from tri qualify count(*) over (partition by r, k) > 1),
cov as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from rep) group by r),
f as (
  select r, doc_id, host, len(ws)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(cov.n, 0)::bigint as n_repeat_words
  from words left join cov using (r)),
g as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         word_chars::double / greatest(n_words, 1) as mean from f),
h as (
  select host, count(*)::bigint as host_docs,
         sum((base_failed or mean < 2 or mean > 15 or 2 * n_symbols > n_words or 10 * n_dup_lines > n_words)::bigint)::bigint as host_fails
  from g group by host),
q as (select sum(host_fails) / sum(host_docs) as m, var_pop(host_fails / host_docs) as a, avg(1 / host_docs) as c from h),
p as (select m, greatest({PRIOR_LEAST}, least({PRIOR_MOST}, case when a - m * (1 - m) * c > 0 then m * (1 - m) / (a - m * (1 - m) * c) - 1 else {PRIOR_MOST} end)) as pw from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and (host_fails + m * pw) / (host_docs + pw) <= {HOST_LIMIT} as kept, host, host_docs, host_fails, round((host_fails + m * pw) / (host_docs + pw), 9) as host_rate
from g join h using (host), p
"""
