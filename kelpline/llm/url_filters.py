"""URL rules by a sort-merge range join.

A host becomes a key of its labels in reverse, each with a dot after it (net.example.), so
that a rule's host and its subdomains are the interval of keys that start with the rule's.
Urls and rules are dealt out by ranges of keys, sorted, and swept once; a stack holds the
rule hosts whose intervals contain the current key, and each of them its paths.

Defined results: the longest rule (host and path) that fits wins, of equal ones that with the
longer host; a rule that is there for both verdicts blocks; where none fits, rule is null and
the verdict is allow. A url that is null or has no :// has host and path ''. Rows that repeat
are each judged; empty tables give empty results; other columns are dropped. Rules with a null
in them, or an empty host, fit nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az, pick, table

#: About so many keys place the bounds of ranges; they decide on balance alone, not on results.
BOUND_SAMPLE = 20_000
DEFAULT = "allow"
#: Verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_and_path(urls: DataFrame) -> DataFrame:
    """urls (page_id, url) with host and path, after the first ://."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    out = urls.withColumn("_rest", F.coalesce(rest, F.lit("")))
    return out.select("page_id", lower_az(F.regexp_extract("_rest", r"^[^/?#]*", 0)).alias("host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def key_of(host):
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def bounds_of(points: DataFrame, parts: int, sample: int = BOUND_SAMPLE) -> list[str]:
    """Up to parts - 1 keys that cut the points into ranges of like size, from the rows whose hash is under a threshold."""
    share = min(1.0, sample / max(points.count(), 1))
    drawn = points.where(F.pmod(F.xxhash64("page_id", "path", "host"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Equal rows have one hash, so keys come with their numbers and are never more than the sample's distinct ones.
    counted = sorted((r.key, r.n) for r in drawn.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect())
    total, at, out = sum(n for _, n in counted), 0, []
    for key, n in counted:
        at += n
        while len(out) < parts - 1 and at > total * (len(out) + 1) // parts:
            out.append(key)
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict. rules: verdict, host, path."""
    spark = pages.sparkSession
    points = host_and_path(pick(pages, "page_id", "url")).withColumn("key", key_of(F.col("host")))
    rules = pick(rules, "verdict", "host", "path").where("verdict is not null and host <> '' and path is not null")
    rules = rules.withColumn("host", lower_az(F.col("host"))).withColumn("key", key_of(F.col("host")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = bounds_of(points, parts)

    @F.pandas_udf("int")
    def part_of(key: pd.Series, spread: pd.Series) -> pd.Series:
        """A key that is several bounds, as a hot host's, is spread over the ranges between them."""
        out = []
        for k, h in zip(key, spread):
            lo, hi = bisect_left(bounds, k), bisect_right(bounds, k)
            out.append(lo + h % (hi - lo + 1))
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("array<int>")
    def parts_of(key: pd.Series) -> pd.Series:
        """All ranges that may hold a key which starts with this one."""
        return pd.Series([list(range(bisect_left(bounds, k), bisect_right(bounds, k + chr(0x10FFFF)) + 1)) for k in key])

    points = points.select(part_of("key", F.xxhash64("page_id", "path", "host")).alias("part"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    rules = rules.select(F.explode(parts_of("key")).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    swept = points.unionByName(rules).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "kind").select("part", "key", "kind", "page_id", "host", "path", "verdict")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []  # of key, host, {path: verdict}, its paths' lengths from the longest
        for batch in batches:
            out = []
            for own, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part:
                    part, stack = own, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    _, _, paths, lengths = stack[-1]
                    paths[path] = "block" if "block" in (paths.get(path), verdict) else verdict
                    lengths[:] = sorted({len(p) for p in paths}, reverse=True)
                    continue
                best = (-1, 0, None, default)
                for _, of, paths, lengths in stack:
                    for n in lengths:
                        if (found := paths.get(path[:n])) and n <= len(path):
                            best = max(best, (len(of) + n, len(of), of + path[:n], found), key=lambda x: x[:2])
                            break
                out.append((page_id, host, path, best[2], best[3]))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(cols)], names=["page_id", "host", "path", "rule", "verdict"])

    return swept.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "verdict string, host string, path string"))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP3_SQL = f"""
with r(verdict, rhost, rpath) as (values {_VALUES}),
p as (
  select row_number() over () as n, page_id,
         case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (
  select n, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from p),
m as (
  select n, rhost || rpath as rule, r.verdict, row_number() over (partition by n order by length(rhost || rpath) desc, length(rhost) desc) as k
  from u join r on ('.' || host) like ('%.' || rhost) and starts_with(path, rpath))
select page_id, host, path, m.rule, coalesce(m.verdict, '{DEFAULT}') as verdict
from u left join m on u.n = m.n and m.k = 1
"""
