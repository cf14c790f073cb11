import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kelpline.llm import suffix_dedup as S

DOCS = "doc_id long, text string"


def brute(texts, length):
    """n_bytes, n_removed, n_spans, sha256 of each text."""
    raw = [(t or "").encode() for t in texts]
    places = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if places[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(np.diff(gone[:-1].astype(int), prepend=0) == 1))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def check(spark, texts, length=40, shared=30, first=10, parts=5):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(parts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.repeated_bytes(docs, length, shared, first).collect()}
    want = dict(enumerate(brute(texts, length)))
    assert got == want
    return got


def test_least_and_grams():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 50, 137).astype(np.uint64)
    assert (S.least(keys, 9) == [keys[i : i + 9].min() for i in range(129)]).all()
    raw = rng.integers(0, 3, 500).astype(np.uint8)
    h = S.grams(raw, 4)
    assert len({(int(h[i]), raw[i : i + 4].tobytes()) for i in range(497)}) == len({raw[i : i + 4].tobytes() for i in range(497)})


def test_stretches_are_cut_alike_in_parts(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("ab") for _ in range(5000)).encode()
    start, stop, _ = S.stretches(text, 40, 30)
    assert start[0] == 0 and stop[-1] == 4961 and (start[1:] == stop[:-1]).all()
    monkeypatch.setattr(S, "PART", 700)
    a, b, g = S.stretches(text, 40, 30)
    assert a[0] == 0 and b[-1] == 4961 and (a[1:] == b[:-1]).all() and set(start) <= set(a)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n, letters="abcdefgh é": "".join(rng.choice(letters) for _ in range(n))
    shared = [word(n) for n in (39, 40, 41, 90, 200)]
    texts = []
    for _ in range(120):
        parts = [word(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, len(p) // 2)
            parts += [p[a : a + rng.randrange(20, 200)], word(rng.randrange(0, 60))]
        texts.append("".join(parts))
    texts += [texts[3]] * 30 + [texts[5] + "x", texts[5][1:], "", None, "a" * 39, "a" * 40, "a" * 300, "ab" * 100, word(5) + "ab" * 30, shared[4] * 3, word(500, "ab"), word(500, "ab")]
    got = check(spark, texts, parts=seed + 2)
    assert sum(r[1] > 0 for r in got.values()) > 60


def test_production_parameters(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    p = word(900)
    texts = [word(700) + p[:399] + word(100), word(50) + p[:400] + word(50), p, word(600), p[200:] + word(3000), word(400), "z" * 2000]
    texts += [texts[3] + "!", word(100) + texts[5] * 2]
    check(spark, texts, S.LENGTH, S.SHARED, S.FIRST)


def test_odd_rows(spark):
    text = "".join(random.Random(1).choice("abcd") for _ in range(600))
    rows = [(1, text, "t"), (1, text, "u"), (None, "x" + text, None), (None, None, None), (2, "", ""), (3, text[:399], "")]
    docs = spark.createDataFrame(rows, f"{DOCS}, other string").withColumnRenamed("other", "TEXT")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in S.repeated_bytes(docs).collect())
    assert got == [(0, 0, 0, 0), (0, 601, 600, 1), (1, 600, 600, 1), (1, 600, 600, 1), (2, 0, 0, 0), (3, 399, 0, 0)]
    assert S.repeated_bytes(docs.limit(0)).count() == 0


def test_very_long_text_of_one_letter(spark):
    docs = spark.createDataFrame([(1, "a" * 300_000), (2, "b" * 200_000 + "c"), (3, "word " * 50_000)], DOCS)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.repeated_bytes(docs).collect()}
    assert got == {1: (300_000, 1), 2: (200_000, 1), 3: (250_000, 1)}
