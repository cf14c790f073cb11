import base64
import hashlib
import random

import pytest

from kelpline.llm import url_filters as U
from kelpline.llm import warc as W

RULES = "verdict string, host string, path string"


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, U.DEFAULT))
    return host, path, best[2], best[3]


def test_urls(spark):
    rng = random.Random(2)
    rules = [*U.RULES, ("block", "a.b.net", "/en/x"), ("allow", "b.net", "/en/"), ("block", "com", "")]
    urls = [None, "", "nohost", "http://", "http://NET/x", "https://net", "http://xnet/a", "http://é.org/fr/1?x#y", "http://example.com?/de/"]
    urls += ["http://" + ".".join(rng.choices(["a", "b", "example", "x"], k=rng.randrange(1, 4))) + rng.choice([".net", ".org", ".com"]) + rng.choice(["/en/x1", "/de/", "/fr/2", "/", ""]) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, URL string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, spark.createDataFrame(rules, RULES)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert U.judge_urls(pages.limit(0), spark.createDataFrame(rules, RULES)).count() == 0
    assert U.judge_urls(pages, spark.createDataFrame([], RULES)).count() == len(urls)


def test_warc(spark, tmp_path):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, None), (5, "http://e\r\nX: y", ""), (7, "u", "x" * 5000 + "é"), (None, "n", "same"), (8, "s", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    W.write_archive(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in W.read_archive(spark, str(tmp_path / "w")).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and got[i].payload_bytes == len(raw) and bytes(got[i].payload) == raw
        assert bytes(got[i].record).startswith(b"WARC/1.0\r\n")
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {3: ("revisit", 1), 1: ("response", None), None: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 7: ("response", None), 8: ("response", None)}
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 4
    W.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert W.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_warc_finds_damage(spark, tmp_path):
    W.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), str(tmp_path / "w"))
    bad = spark.read.parquet(str(tmp_path / "w/payloads")).selectExpr("sha256", "cast('other' as binary) as payload").collect()
    spark.createDataFrame(bad, "sha256 string, payload binary").write.mode("overwrite").parquet(str(tmp_path / "w/payloads"))
    with pytest.raises(Exception, match="damaged"):
        W.read_archive(spark, str(tmp_path / "w")).collect()


def test_urls_and_records_of_odd_rows(spark, tmp_path):
    long = "http://example.net/en/" + "p" * 100_000
    rows = [(1, long, "same"), (1, long, "same"), (None, long, "same"), (None, None, None), (2, "http://x.example.com/de/1", "same")]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, Html2 string")
    got = U.judge_urls(pages, spark.createDataFrame(U.RULES, RULES)).collect()
    assert len(got) == 5 and sorted((str(r.rule), r.verdict) for r in got) == [("None", "allow"), ("example.com/de/", "block"), ("example.net/en/", "allow"), ("example.net/en/", "allow"), ("example.net/en/", "allow")]
    assert U.bounds_of(spark.createDataFrame([(i, "k" if i % 2 else f"a{i:03}", "/", "h") for i in range(200)], "page_id long, key string, path string, host string"), 4) == ["a100", "k", "k"]
    W.write_archive(pages, str(tmp_path / "w"))
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in W.read_archive(spark, str(tmp_path / "w")).collect()]
    # Of the rows that repeat with the smallest id, one is the response.
    assert sorted(map(str, kinds)) == sorted(map(str, [(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (2, "revisit", 1), (None, "response", None)]))
