import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import exact_dedup as X
from kelpline.llm import near_dedup as N
from kelpline.llm import substrings as S

DOCS = "doc_id long, text string"
FULL = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_fingerprints_compose():
    p = X.Fingerprinter()
    a, b = np.frombuffer(b"ab" * 999, np.uint8), np.frombuffer(b"xyz" * 500, np.uint8)
    whole = p.chunk(np.concatenate([a, b]))
    assert (p.combine(p.chunk(a), p.chunk(b), len(b)) == whole).all()
    assert p.text(b"q" * 10000) != p.text(b"q" * 9999 + b"r")


@pytest.mark.parametrize("moduli, piece, per_task", [(X.MODULI, X.PIECE, X.PER_TASK), ((1, 1, 1, 1), X.PIECE, X.PER_TASK), (X.MODULI, 4100, 5), ((1, 1, 1, 1), 7000, 5)])
def test_exact(spark, moduli, piece, per_task):
    rng = random.Random(3)
    texts = [None, "", "Abc", "aBC", "É", "é", "x" * 20000, "X" * 20000, "x" * 19999 + "y", "y" + "x" * 19999] + [rng.choice("pqr") for _ in range(40)]
    rows = list(enumerate(texts)) + [(None, "abc"), (5, "É")]
    docs = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, other string").withColumnRenamed("other", "TEXT")
    lower = lambda t: (t or "").encode().translate(X.LOWER_BYTES)
    got = X.exact_duplicates(docs, moduli, piece, per_task).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    want = {hashlib.sha256(k).hexdigest(): (max((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] and (not r.kept or r.doc_id == r.keep_id) for r in got)
    assert X.exact_duplicates(docs.limit(0)).count() == 0


def test_pieces_sum_to_the_whole(spark):
    rng = random.Random(20)
    texts = ["".join(rng.choice("abcXYZ é") for _ in range(n)) for n in (0, 1, 99, 100, 101, 5000, 9999)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(6, texts[6])], DOCS)
    with X.scratch(spark) as keep:
        cut, whole = (sorted((r.doc_id, r.f1, r.f2, r.n_bytes) for r in X.fingerprints(docs, k, piece=p)[0].collect()) for p, k in ((100, keep), (1 << 20, lambda df, n: df)))
    assert cut == whole and len(cut) == 8


def jaccard(a, b):
    def w(t):
        ws = t.lower().split()
        k = min(5, len(ws))
        out = {}
        for i in range(len(ws) - k + 1 if ws else 0):
            out[tuple(ws[i : i + k])] = out.get(tuple(ws[i : i + k]), 0) + 1
        return out

    x, y = w(a), w(b)
    if not x or not y:
        return float(not x and not y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x.keys() & y.keys())


def test_near_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = words(rng, 300)
        texts.append(" ".join(base))
        for edits in (1, 3, 12):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    texts += ["", None, "two words", "Two  WORDS", *[texts[0]] * 30]
    got = {r.doc_id: r for r in N.near_classes(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS + ", Doc_Id2 string"), sketches=False).collect()}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i] or "", texts[j] or "") >= 0.8 - 1e-12:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert [got[i].class_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert sum(r.kept for r in got.values()) == len({find(i) for i in range(len(texts))})


def test_near_stage_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (None, "other text here", None, None, None)], FULL)
    out = N.near_stage(spark, docs, "").collect()
    assert {r.doc_id for r in out} == {1, None} and len(out) == 2
    assert N.near_stage(spark, docs.limit(0), "").count() == 0


def test_substrings(spark):
    rng = random.Random(7)
    shared = words(rng, 80)
    fuzzy = list(shared)
    fuzzy[40:41] = ["inserted", "words"]
    docs = [(1, " ".join(words(rng, 200) + shared + words(rng, 200))), (2, " ".join(words(rng, 50) + shared + words(rng, 50))), (3, " ".join(words(rng, 90) + fuzzy + words(rng, 10))), (4, " ".join(words(rng, 300))), (5, None), (6, "")]
    df = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r for r in S.repeats(df).collect()}
    assert set(got) == {2, 3} and got[2].home_id == 1
    assert abs(got[2].start - 50) <= 1 and abs(got[2].stop - 130) <= 1 and abs(got[3].start - 90) <= 1 and abs(got[3].stop - 171) <= 1
    full = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    left = {r.doc_id: r.text for r in S.substring_stage(spark, full, "").collect()}
    assert len(left[2].split()) in range(98, 103) and left[1] == docs[0][1] and left[4] == docs[3][1]
    assert S.repeats(df.limit(0)).count() == 0


def test_chain_is_increasing():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    best = S.chain(x, y)[0]
    assert (np.diff(x[best]) > 0).all() and (np.diff(y[best]) > 0).all()


def test_templates_share_no_passage(spark):
    rng = random.Random(11)
    head, foot = words(rng, 15), words(rng, 15)
    filled = lambda: head + [f"x{rng.random()}" for _ in range(30)] + foot + [f"x{rng.random()}" for _ in range(20)]
    # Two lines in common 30 different words apart; then a passage of 60 with one word changed, which stays.
    shared = words(rng, 60)
    changed = shared[:30] + ["other"] + shared[31:]
    docs = [(1, " ".join(filled())), (2, " ".join(filled())), (3, " ".join(filled() + shared)), (4, " ".join(filled() + changed))]
    texts = [np.arange(6).tolist() + [100 + d * 100 + i for i in range(49)] + np.arange(6, 12).tolist() for d in range(2)]
    a, b = (np.array(x) for x in texts)
    assert S.parts(a, b, np.array([[0, 61, 0]])) == [(0, 6, 0, 6), (55, 61, 55, 61)]
    got = {r.doc_id: (r.start, r.stop) for r in S.repeats(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {4: (80, 140)}


def best_score(a, b):
    row = [S.OTHER * j for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [S.OTHER * (i + 1)]
        for j, y in enumerate(b):
            new.append(max(row[j] + (S.EQUAL if x == y else S.OTHER), row[j + 1] + S.OTHER, new[j] + S.OTHER))
        row = new
    return row[-1]


def test_between_is_the_best_alignment():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 9, rng.integers(0, 14)) for _ in range(2))
        steps = S.STEPS[S.between(a, b)]
        assert steps[:, 0].sum() == best_score(a.tolist(), b.tolist())
        assert (steps[:, 1].sum(), steps[:, 2].sum()) == (len(a), len(b))


def test_straight_is_chain():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = np.cumsum(rng.choice([1, 5, 9, 25, 40, 58, 90], rng.integers(1, 30)))
        assert sorted(list(c) for c in S.straight(x)) == sorted(S.chain(x, x + 7))


def test_passage_of_seeds_that_others_have(spark):
    rng = random.Random(13)
    shared = words(rng, 90)
    # Every 6 words of the passage are in documents with smaller ids too, 11 words together at most.
    small = [" ".join(words(rng, 20, 10**9) + shared[i : i + 11] + words(rng, 20, 10**9)) for _ in range(25) for i in range(0, 84, 6)]
    docs = [*enumerate(small), (5000, " ".join(words(rng, 60, 10**9) + shared + words(rng, 60, 10**9))), (5001, " ".join(words(rng, 40, 10**9) + shared + words(rng, 70, 10**9)))]
    got = {r.doc_id: r for r in S.repeats(spark.createDataFrame(docs, DOCS)).collect()}
    # By brute force no other two documents share 12 words.
    grams = {}
    for d, t in docs:
        w = t.split()
        for i in range(len(w) - 11):
            grams.setdefault(tuple(w[i : i + 12]), set()).add(d)
    assert {frozenset(v) for v in grams.values() if len(v) > 1} == {frozenset((5000, 5001))}
    assert set(got) == {5001} and got[5001].home_id == 5000
    assert abs(got[5001].start - 40) <= 1 and abs(got[5001].stop - 130) <= 1


def test_words_over_and_over(spark):
    rng = random.Random(17)
    again = ["is", "so."] * 60
    docs = [(i, " ".join(words(rng, 30 + 7 * i, 10**9) + again + words(rng, 40, 10**9))) for i in range(8)]
    found = S.repeats(spark.createDataFrame(docs, DOCS)).collect()
    assert {r.doc_id: (r.start, r.stop) for r in found} == {i: (30 + 7 * i, 150 + 7 * i) for i in range(1, 8)}
    # A chain for each document, and not for each place.
    with S.scratch(spark) as keep:
        texts = S.numbered(spark.createDataFrame(docs, DOCS), keep)
        assert S.regions(S.placed(S.seeds(texts), "shared", keep), False).count() == 7


def test_repeats_of_odd_rows(spark):
    rng = random.Random(18)
    shared, same = words(rng, 70), " ".join(words(rng, 60, 10**9))
    long = " ".join(words(rng, 30_000, 10**9) + shared + words(rng, 30_000, 10**9))
    rows = [(1, " ".join(shared)), (1, " ".join(shared)), (2, long), (None, " ".join(words(rng, 9) + shared)), (None, None), (3, ""), (4, same), (4, same), (4, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, DOC_ID string")
    got = {(r.doc_id, r.start, r.stop, r.home_id) for r in S.repeats(docs).collect()}
    assert got == {(2, 30_000, 30_070, 1), (None, 9, 79, 1)}
    full = spark.createDataFrame([(i, t, "en", None, len(t or ""), 5) for i, t in rows], FULL + ", Lang long")
    out = S.substring_stage(spark, full, "").collect()
    left = {r.doc_id: r for r in out if r.text}
    assert len(left[2].text.split()) == 60_000 and len(left[None].text.split()) == 9 and left[None].n_chars == len(left[None].text)
    # Texts that were empty before stay; repeated rows stay alike.
    assert len(out) == len(rows) and sum(r.doc_id == 1 for r in out) == 2 and sum(not r.text for r in out) == 3


def test_a_stray_match_changes_nothing(spark):
    """Three runs of 15 words with others between, which are no passage; with and without one more match elsewhere."""
    rng = random.Random(19)
    runs = [words(rng, 15) for _ in range(3)]
    stray = words(rng, 9)
    for extra in ([], stray):
        docs = [(i, " ".join([w for r in runs for w in r + words(rng, 46, 10**9)] + extra + words(rng, 20, 10**9))) for i in range(12)]
        assert S.repeats(spark.createDataFrame(docs, DOCS)).count() == 0


def test_chain_is_the_best():
    """Against all chains, by the definition of their score."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        x, y = rng.integers(0, 120, n), rng.integers(0, 120, n)

        def value(c):
            total = float(S.SEED)
            for i, j in zip(c, c[1:]):
                dx, dy = x[j] - x[i], y[j] - y[i]
                total += min(S.SEED, dx, dy) - S.GAP_COST * (dx + dy)
            return total

        best = 0.0
        for mask in range(1, 1 << n):
            c = sorted((i for i in range(n) if mask >> i & 1), key=lambda i: x[i])
            if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:])):
                best = max(best, value(c))
        # The tree weighs a predecessor by its score before the new match's own words are known to overlap.
        assert best - S.SEED < value(S.chain(x, y)[0]) <= best + 1e-9


def test_texts_under_one_id_are_told_apart(spark):
    rng = random.Random(31)
    shared = [words(rng, 60, 10**6) for _ in range(3)]
    rows = [(1, " ".join(words(rng, 30, 10**6) + shared[k] + words(rng, 30, 10**6))) for k in range(3)]
    rows += [(i, " ".join(words(rng, 20 + k, 10**6) + shared[k % 3] + words(rng, 25, 10**6))) for i in (None, 5) for k in range(30)]
    rows += [(None, t) for _, t in rows[3:6]] + [(None, " ".join(words(rng, 70, 10**6)))] * 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], FULL).repartition(5)
    known, repeated = S.told_by_number(docs)
    numbers = {(r.doc_id, r.text): r.text_number for r in known.collect()}
    assert repeated and len(set(zip([i for i, _ in numbers], numbers.values()))) == len(numbers)
    found = S.repeats(docs)
    cut = {(r.doc_id, r.text_number): (r.start, r.stop) for r in found.collect()}
    for (i, t), n in numbers.items():
        at = next((t.split().index(s[0]) for s in shared if s[0] in t.split()), None)
        assert cut.get((i, n)) == (None if i == 1 or at is None else (at, at + 60)), (i, t)
    left = S.without_repeats(docs, found).collect()
    assert len(left) == len(rows) and sum(" ".join(s) in r.text for s in shared for r in left) == 3


def brute_shared(texts, least):
    """Of each text (in order of ids) the words in runs of least words or more that an earlier text has."""
    seen, out = set(), []
    for text in texts:
        w = text.lower().split()
        runs = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        out.append({j for i, r in enumerate(runs) if r in seen for j in range(i, i + least)})
        seen.update(runs)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substrings_recall_against_brute_force(spark, seed):
    """Every shared word of every run of 50 equal words or more is looked for; what is found besides must be near such a run."""
    rng = random.Random(seed)
    passages = [words(rng, rng.randrange(50, 120), 3000) for _ in range(25)]
    texts = []
    for _ in range(300):
        out = words(rng, rng.randrange(0, 150), 3000)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 3)
            out += p[a : a + rng.randrange(45, 120)] + words(rng, rng.randrange(0, 60), 3000)
        texts.append(" ".join(out))
    want = brute_shared(texts, S.MIN_WORDS)
    got = [set() for _ in texts]
    for r in S.repeats(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)).collect():
        got[r.doc_id] |= set(range(r.start, r.stop))
    total, hit = sum(map(len, want)), sum(len(w & g) for w, g in zip(want, got))
    assert total > 2000 and hit >= 0.97 * total, (hit, total)
    # Passages are joined from neighbouring stretches of 12 words or more that an earlier text has.
    shorter = brute_shared(texts, 12)
    over = sum(len(g - s) for g, s in zip(got, shorter))
    assert over <= 0.02 * sum(map(len, got)), over
