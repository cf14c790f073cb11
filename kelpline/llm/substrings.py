"""Passages that documents share, by chained seeds.

Seeds are runs of SEED words whose hash is the smallest of WINDOW neighbouring runs, so every
shared run of SEED + WINDOW - 1 words has one. A seed's home is its first place in the document
with the smallest id that has it; every other document joins its places to that one, so a seed
of n places gives n matches at most, and not the pairs of them. In words that repeat over and over
a seed is another one each time, so such stretches match in order. Matches of two documents are
chained: increasing in both, each worth its words less a cost for the gaps, by a Fenwick tree
over the prefix maxima. Chains are cut at wide gaps.

The home of a frequent seed need not have what is around it. So where a document's shared seeds
are in no chain that spans half of MIN_WORDS, every GROUP neighbouring ones at their distances
get a home of their own and are matched and chained in a second turn; each MIN_WORDS shared
words have such a group.

Chains are aligned, gaps allowed, between their matches and beyond their ends, and split where
the score drops by DROP. Texts meet the ranges of words that chains ask for, each range once, and
ranges meet in pairs; no whole text goes to a chain. Aligned stretches of a document that meet
join to passages, of which those of MIN_WORDS or more are repeats. What stays is the home's copy.

A frequent seed's places are joined to its one home by a plain join of two tables, which adaptive
execution splits where it is skewed; so are the chains that ask for one range of a home.

Defined results: documents are known by doc_id and, where an id repeats, by the number of the text
among the id's (rows with equal ones are one document, and all of them lose its repeats; texts
differ under one id, or null, without harm); a null doc_id comes last, as the largest; a null text is empty; repeats within a document alone are left; empty
tables give empty results; other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import row_numbers
from .common import SPACE_CLASS, pick, scratch, settled, table, written
from .shingles import mix, windows, word_hashes

SEED, WINDOW, MIN_WORDS = 6, 10, 50
#: Of MIN_WORDS equal words the MIN_WORDS - SEED - WINDOW + 2 windows have so many different seeds at least.
GROUP = -(-(MIN_WORDS - SEED - WINDOW + 2) // WINDOW)
GAP_COST = 0.1
#: Chains are cut where matches are further apart than this, and those that span less are no start of a passage.
MAX_GAP, MIN_SPAN = 60, 12
#: Words looked at beyond a chain's ends; scores of a word that is equal and of one that isn't or is missing; the drop that ends an extension and splits a chain.
BEYOND, EQUAL, OTHER, DROP = 40, 1.0, -1.5, 8.0
LAST = (1 << 63) - 1
#: Ranges of words begin and end at multiples of this, so that chains of one passage ask for one range.
RANGE = 64
REGION = "doc_id long, text_number long, start int, stop int, home long, home_number long, home_start int, home_stop int, runs array<int>"
NAMES = [x.split()[0] for x in REGION.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] * 2 + [pa.list_(pa.int32())]
FOUND = "seed long, doc_id long, tail long, more int, again boolean"
#: Steps of an alignment (equal words, different words, a word missing in b or in a): their scores and the words of a and b that they take.
STEPS = np.array([[EQUAL, 1, 1], [OTHER, 1, 1], [OTHER, 1, 0], [OTHER, 0, 1]])


def seeds_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's seeds."""
    if len(words) < SEED:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    h = windows(words, SEED)
    n = max(1, len(h) - WINDOW + 1)
    least = np.lib.stride_tricks.sliding_window_view(h, min(WINDOW, len(h))).argmin(axis=1)
    at = np.unique(least + np.arange(n))
    return h[at].view(np.int64), at.astype(np.int32)


def mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) ^ more.astype(np.uint64))


def told_by_number(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs (doc_id, text, more) with text_number: 0 where no other row has the id, else the number, from 1, of its text among the id's, by their SHA-256; and whether any id repeats.

    The number depends on ids and texts alone, so it is the same whenever it is taken. Numbers are
    counted in ranges, as an id (null above all) may be that of any share of the rows.
    """
    again = settled(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return docs.withColumn("text_number", F.lit(0).cast("long")), False
    named = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    own = named.select("doc_id", "_sha").join(again.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").distinct()
    numbers = settled(row_numbers(own, ["doc_id"], ["_sha"], "_number")).withColumnsRenamed({"doc_id": "_id", "_sha": "_s"})
    both = named.join(numbers, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_s")), "left")
    return both.withColumn("text_number", F.coalesce(F.col("_number").cast("long"), F.lit(0).cast("long"))).drop("_id", "_s", "_sha", "_number"), True


def numbered(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """doc_id, text_number (the number that tells texts under one id apart), body; a row for each document."""
    docs = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    known, repeated = told_by_number(docs)
    out = known.select("doc_id", "text_number", F.col("text").cast("binary").alias("body"))
    # Where no id repeats nothing is joined: rows are read from docs again and not written.
    return keep(out.dropDuplicates(["doc_id", "text_number"]), "texts") if repeated else out


def first_places(seed: np.ndarray) -> np.ndarray:
    """Whether a value is there before, by place."""
    again = np.ones(len(seed), bool)
    again[np.unique(seed, return_index=True)[1]] = False
    return again


def told_apart(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's seeds, where those that come again within SEED + WINDOW words are told apart by how often they have, and which are there before.

    So in words that repeat over and over, as in two texts that have such a stretch, seeds are matched in order and not all to the first.
    """
    order = np.lexsort((at, h))
    again = np.append(False, h[order][1:] == h[order][:-1])[: len(h)]
    near = again & (np.diff(at[order], prepend=0) <= SEED + WINDOW)
    if near.any():
        step = np.arange(len(h))
        turn = step - np.maximum.accumulate(np.where(near, 0, step))
        h, turns = h.copy(), np.empty(len(h), np.int64)
        turns[order] = turn
        h[turns > 0] = mixed(h[turns > 0].view(np.uint64), turns[turns > 0]).view(np.int64)
        return h, first_places(h)
    out = np.empty(len(h), bool)
    out[order] = again
    return h, out


def seeds(texts: DataFrame) -> DataFrame:
    """FOUND of numbered() rows: tail is text_number << 32 | place, again says that the document has the seed before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [seeds_of(w) for w in word_hashes([x or b"" for x in part.column(2).to_pylist()])]
                n = [len(h) for h, _ in found]
                doc, text = (np.repeat(part.column(j).to_numpy(), n) for j in (0, 1))
                named = [told_apart(h, at) for h, at in found]
                cols = [np.concatenate([h for h, _ in named]), doc, text << 32 | np.concatenate([at for _, at in found]), np.zeros(sum(n), np.int32), np.concatenate([again for _, again in named])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["seed", "doc_id", "tail", "more", "again"])

    return texts.mapInArrow(run, FOUND)


def placed(found: DataFrame, name: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """doc_id, text_number, at, home, home_number, home_at, more: every place of a seed that several documents have, its home's too."""
    of = lambda x: F.shiftright(x, 32)
    at = lambda x: F.col(x).bitwiseAND(0xFFFFFFFF).cast("int")
    first = found.where("not again").groupBy("seed").agg(F.min_by("tail", "doc_id").alias("home_tail"), F.min("doc_id").alias("home"), F.max("doc_id").alias("last"), F.min("tail").alias("t0"), F.max("tail").alias("t1"))
    shared = keep(first.where((F.col("home") < F.col("last")) | (of("t0") != of("t1"))).select("seed", "home", "home_tail"), name)
    return found.join(shared, "seed").select("doc_id", of("tail").alias("text_number"), at("tail").alias("at"), "home", of("home_tail").alias("home_number"), at("home_tail").alias("home_at"), "more")


def chain(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Chains of matches (x, y), best first, as indices; each match is in one at most.

    A Fenwick tree over the ranks of y holds the best score + GAP_COST * (x + y) of the matches
    so far, so that the best predecessor with smaller x and y takes a logarithmic look-up.
    """
    order = np.lexsort((-y, x)).tolist()
    ranks = np.unique(y, return_inverse=True)[1].tolist()
    xs, ys = x.tolist(), y.tolist()
    n = max(ranks) + 1
    best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)
    score, before = [0.0] * len(xs), [-1] * len(xs)
    for i in order:  # of equal x the larger y first, so none precedes another
        top, r = (-np.inf, -1), ranks[i]
        while r > 0:
            if best[r] > top:
                top = best[r]
            r -= r & -r
        place = GAP_COST * (xs[i] + ys[i])
        gain = top[0] - place
        if gain > 0:
            j = top[1]
            score[i], before[i] = gain + min(SEED, xs[i] - xs[j], ys[i] - ys[j]), j
        else:
            score[i] = SEED
        r, mine = ranks[i] + 1, (score[i] + place, i)
        while r <= n:
            if mine > best[r]:
                best[r] = mine
            r += r & -r
    used, out = [False] * len(xs), []
    for i in sorted(range(len(xs)), key=lambda i: -score[i]):
        one = []
        while i >= 0 and not used[i]:
            used[i] = True
            one.append(i)
            i = before[i]
        if one:
            out.append(one[::-1])
    return out


def straight(x: np.ndarray) -> list[range]:
    """chain() of increasing matches on one diagonal, where the best predecessor is always the one before."""
    out, s = [], 0
    while s < len(x):
        # Best score + GAP_COST * (x + y), as if no gap from s on cost more than all before it is worth.
        place = 2 * GAP_COST * (x[s:] - x[s])
        total = SEED + np.concatenate([[0], np.cumsum(np.minimum(SEED, np.diff(x[s:])))])
        ends = np.flatnonzero(total[:-1] - place[1:] <= 0)
        n = int(ends[0]) + 1 if len(ends) else len(total)
        score = (total - place)[:n]
        after = np.append(np.maximum.accumulate(score[::-1])[::-1][1:], -np.inf)
        cuts = [0, *(np.flatnonzero(score >= after) + 1).tolist()]
        out += [range(s + i, s + j) for i, j in zip(cuts, cuts[1:])]
        s += n
    return out


def cut(key: tuple, x: np.ndarray, y: np.ndarray, more: np.ndarray) -> Iterator[tuple]:
    """The chains of two documents' matches, cut at wide gaps, as rows of REGION."""
    whole = more > 0
    steps = [0 * more[whole], *[more[whole] >> 8 * i & 255 for i in range(GROUP - 1)]]
    x, y = (np.concatenate([v[~whole], *[v[whole] + s for s in steps]]).astype(np.int64) for v in (x, y))
    x, y = np.divmod(np.unique(x << 32 | y), 1 << 32)
    one = np.all(np.diff(y - x) == 0) and np.all(np.diff(x) > 0)
    for c in straight(x) if one else chain(x, y):
        a, b = (x[c.start : c.stop], y[c.start : c.stop]) if one else (x[c], y[c])
        ends = np.flatnonzero((np.diff(a) > MAX_GAP) | (np.diff(b) > MAX_GAP)) + 1
        for s, e in zip([0, *ends], [*ends, len(c)]):
            if a[e - 1] + SEED - a[s] >= MIN_SPAN:
                turns = np.flatnonzero(np.diff((b - a)[s:e])) + 1 + s
                firsts, lasts = np.array([s, *turns]), np.array([*turns, e]) - 1
                runs = np.column_stack([a[firsts], a[lasts] + SEED, b[firsts]]).ravel()
                yield (key[0], key[1], int(a[s]), int(a[e - 1]) + SEED, key[2], key[3], int(b[s]), int(b[e - 1]) + SEED, runs)


def chained(cols: list[np.ndarray]) -> list[tuple]:
    """REGION rows of whole documents' rows of placed(), in order of document, home and place."""
    doc, text, home, home_text, at, home_at, more = cols
    new = np.any([np.diff(c) != 0 for c in cols[:4]], axis=0)
    starts = np.append(0, np.flatnonzero(new) + 1)
    stops = np.append(starts[1:], len(doc))
    reach = SEED + (more >> 8 * (GROUP - 2) & 255)
    spans = [np.maximum.reduceat(c + reach, starts) - np.minimum.reduceat(c, starts) for c in (at, home_at)]
    apart = (doc[starts] != home[starts]) | (text[starts] != home_text[starts])
    out: list[tuple] = []
    # Others make no region: their matches span too little.
    for k in np.flatnonzero(apart & (spans[0] >= MIN_SPAN) & (spans[1] >= MIN_SPAN)).tolist():
        s, e = starts[k], stops[k]
        out += cut(tuple(int(c[s]) for c in cols[:4]), at[s:e], home_at[s:e], more[s:e])
    return out


def unchained(cols: list[np.ndarray], found: list[tuple]) -> list[np.ndarray]:
    """FOUND columns of the groups of GROUP neighbouring shared seeds of which one at least is in no region of found that spans half of MIN_WORDS."""
    doc, text, home, home_text, at, home_at, _ = cols
    number = np.cumsum(np.append(False, (np.diff(doc) != 0) | (np.diff(text) != 0)))
    key = number << 32 | at
    order = np.argsort(key, kind="stable")
    key = key[order]
    wide = [r for r in found if r[3] - r[2] >= MIN_WORDS // 2]
    inside = np.zeros(len(key) + 1, np.int64)
    if wide:
        of = {(d, t): n for d, t, n in zip(doc[order].tolist(), text[order].tolist(), number[order].tolist())}
        base = np.array([of[r[0], r[1]] for r in wide], dtype=np.int64) << 32
        np.add.at(inside, np.searchsorted(key, base + np.array([r[2] for r in wide])), 1)
        np.add.at(inside, np.searchsorted(key, base + np.array([r[3] for r in wide]) - SEED, side="right"), -1)
    free = np.cumsum(inside)[:-1] <= 0
    n = max(0, len(key) - GROUP + 1)
    # A shared seed is known by its home's place.
    name = mixed(home[order].view(np.uint64), home_text[order] << 32 | home_at[order])
    hashes, more = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    fits, any_free = np.ones(n, bool), np.zeros(n, bool)
    for i in range(GROUP):
        step = key[i : i + n] - key[:n]
        hashes = mixed(hashes ^ name[i : i + n], np.where(step < 256, step, 0))
        fits &= step < 256
        any_free |= free[i : i + n]
        if i:
            more |= np.where(step < 256, step, 0) << (8 * i - 8)
    own = np.flatnonzero(fits & any_free)
    rows = order[own]
    seed = hashes[own].view(np.int64)
    return [seed, doc[rows], text[rows] << 32 | at[rows], more[own].astype(np.int32), first_places(mixed(seed.view(np.uint64), number[rows]))]


def regions(shared: DataFrame, grouped: bool) -> DataFrame:
    """Chains of placed(), as REGION in words; runs has start, stop and home's start of each run of matches on a diagonal.

    grouped: with rows of FOUND too, those of unchained(); the columns of the other kind are null.
    """
    order = ["doc_id", "text_number", "home", "home_number", "at"]
    dealt = shared.repartition("doc_id", "text_number").sortWithinPartitions(*order).select(*order, "home_at", "more")
    n_region, kinds = len(NAMES), [*KINDS, pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    schema = f"{REGION}, seed long, tail long, more int, again boolean"

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = chained(cols)
        names = [*NAMES, "seed", "tail", "more", "again"]
        empty = lambda n, at: [pa.nulls(n, kinds[j]) for j in at]
        yield pa.RecordBatch.from_arrays([*rows_of(found).columns, *empty(len(found), range(n_region, len(kinds)))], names=names)
        if grouped:
            seed, doc, tail, more, again = unchained(cols, found)
            for i in range(0, len(seed), 10_000):
                part = [x[i : i + 10_000] for x in (seed, tail, more, again)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[i : i + 10_000]), *empty(len(part[0]), range(1, n_region)), *map(pa.array, part)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(j).to_numpy() for j in range(7)]
            # The rows of the batch's last document wait for more of them.
            ends = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0))
            at = int(ends[-1]) + 1 if len(ends) else 0
            if at:
                yield from out([np.concatenate(c) for c in zip(*held, [c[:at] for c in cols])])
                held = [[c[at:] for c in cols]]
            elif held and (cols[0][0], cols[1][0]) != (held[-1][0][-1], held[-1][1][-1]):
                yield from out([np.concatenate(c) for c in zip(*held)])
                held = [cols]
            else:
                held.append(cols)
        if held:
            yield from out([np.concatenate(c) for c in zip(*held)])

    return dealt.mapInArrow(run, schema)


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(KINDS), KINDS)], names=NAMES)


def extended(a: np.ndarray, b: np.ndarray) -> int:
    """How many words of a, from its beginning, align best with b from its beginning.

    Gapped alignment from one end: rows of a's words, ended when the score has dropped by DROP.
    """
    if not len(a) or not len(b):
        return 0
    steps = np.arange(len(b) + 1) * OTHER
    score, best, taken = steps, 0.0, 0
    for i in range(len(a)):
        new = score + OTHER
        np.maximum(new[1:], score[:-1] + np.where(b == a[i], EQUAL, OTHER), out=new[1:])
        # A gap in a carries a score along: the running maximum of the score less the steps so far.
        score = np.maximum.accumulate(new - steps) + steps
        top = float(score.max())
        if top > best:
            best, taken = top, i + 1
        elif top < best - DROP:
            break
    return taken


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best alignment of all of a with all of b, as STEPS."""
    n = min(len(a), len(b))
    same = np.flatnonzero(a[:n] != b[:n])
    front = int(same[0]) if len(same) else n
    same = np.flatnonzero(a[len(a) - n + front :][::-1] != b[len(b) - n + front :][::-1])
    back = int(same[0]) if len(same) else n - front
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    n = min(len(a), len(b))
    if not np.isin(a, b).any():
        path = [1] * n + [2] * (len(a) - n) + [3] * (len(b) - n)
    else:
        steps = np.arange(len(b) + 1) * OTHER
        score = np.empty((len(a) + 1, len(b) + 1))
        score[0] = steps
        for i in range(len(a)):
            new = score[i] + OTHER
            np.maximum(new[1:], score[i, :-1] + np.where(b == a[i], EQUAL, OTHER), out=new[1:])
            score[i + 1] = np.maximum.accumulate(new - steps) + steps
        of, path, i, j = score.tolist(), [], len(a), len(b)
        while i or j:
            equal = bool(i and j and a[i - 1] == b[j - 1])
            if i and j and of[i][j] == of[i - 1][j - 1] + (EQUAL if equal else OTHER):
                i, j = i - 1, j - 1
                path.append(0 if equal else 1)
            elif i and of[i][j] == of[i - 1][j] + OTHER:
                i -= 1
                path.append(2)
            else:
                j -= 1
                path.append(3)
        path.reverse()
    return np.concatenate([np.zeros(front, np.int8), np.array(path, np.int8), np.zeros(back, np.int8)])


def parts(a: np.ndarray, b: np.ndarray, runs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """A region's runs of matches and what is between, aligned and split where the score drops by DROP: stretches of a and of b."""
    blocks = []
    for x, stop, y in runs.tolist():
        same = a[x:stop] == b[y : y + stop - x]
        edges = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
        blocks += [(x + s, x + e, y + s) for s, e in edges.reshape(-1, 2).tolist() if e - s >= SEED]
    if not blocks:
        return []
    x0, y0 = i, j = blocks[0][0], blocks[0][2]
    path = []
    for x, stop, y in blocks:
        over = max(i - x, j - y, 0)  # of matches that overlap on different diagonals the first is kept
        x, y = x + over, y + over
        if x < stop:
            if x > i or y > j:
                path.append(between(a[i:x], b[j:y]))
            path.append(np.zeros(stop - x, np.int8))
            i, j = stop, y + stop - x
    score, xs, ys = np.concatenate([np.zeros((1, 3)), np.cumsum(STEPS[np.concatenate(path)], axis=0)]).T
    bounds = []
    if (np.maximum.accumulate(score) - score).max() <= DROP:
        bounds.append((0, len(score) - 1))
    else:
        start, top, risen, of = 0, 0, True, score.tolist()
        for k in range(1, len(of)):
            if not risen and of[k] <= of[start]:
                start = top = k
            elif of[k] > of[top]:
                top = k
                risen = risen or of[k] - of[start] >= SEED * EQUAL
            elif of[top] - of[k] > DROP:
                bounds.append((start, top))
                start, top, risen = k, k, False
        bounds.append((start, len(of) - 1))
    return [(x0 + int(xs[s]), x0 + int(xs[e]), y0 + int(ys[s]), y0 + int(ys[e])) for s, e in bounds]


def ranged(start: str, stop: str) -> list:
    """lo, hi: the range of words that a region's side asks for."""
    lo = F.floor(F.greatest(F.col(start) - BEYOND, F.lit(0)) / RANGE) * RANGE
    return [lo.cast("int").alias("lo"), (F.ceil((F.col(stop) + BEYOND) / RANGE) * RANGE).cast("int").alias("hi")]


def slices(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text_number, lo, hi, words (32 bits of their hashes) of the ranges wanted (doc_id, text_number, ranges); ends beyond the text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_number", "lo", "hi", "words"]
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                words = [w.astype(np.uint32).view(np.int32) for w in word_hashes([x or b"" for x in part.column(2).to_pylist()])]
                rows = []
                for doc, text, w, ranges in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), words, part.column(3).to_pylist()):
                    rows += [(doc, text, r["lo"], r["hi"], w[r["lo"] : r["hi"]]) for r in ranges]
                for j in range(0, len(rows), 1000):
                    cols = list(zip(*rows[j : j + 1000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*KINDS[:4], pa.list_(pa.int32())])], names=names)

    both = texts.join(wanted, ["doc_id", "text_number"]).select("doc_id", "text_number", "body", "ranges")
    return both.mapInArrow(run, "doc_id long, text_number long, lo int, hi int, words array<int>")


def passages(found: DataFrame, texts: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """regions() aligned: doc_id, text_number, start, stop (words of the document), home."""
    homes = found.select(F.col("home").alias("doc_id"), F.col("home_number").alias("text_number"), *ranged("home_start", "home_stop"))
    wanted = found.select("doc_id", "text_number", *ranged("start", "stop")).union(homes).distinct()
    wanted = wanted.groupBy("doc_id", "text_number").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    cut_out = keep(slices(texts, wanted), "slices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                doc, text, home, runs, lo, words, home_lo, home_words = (part.column(j) for j in range(8))
                for k, (d, t, h, first, base) in enumerate(zip(doc.to_pylist(), text.to_pylist(), home.to_pylist(), lo.to_pylist(), home_lo.to_pylist())):
                    a, b, of = (np.asarray(c[k].values) for c in (words, home_words, runs))
                    for s, e, hs, he in parts(a, b, of.reshape(-1, 3) - [first, first, base]):
                        s, e = s - extended(a[max(0, s - BEYOND) : s][::-1], b[max(0, hs - BEYOND) : hs][::-1]), e + extended(a[e : e + BEYOND], b[he : he + BEYOND])
                        if e - s >= MIN_SPAN:
                            out.append((d, t, first + s, first + e, h))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, [*KINDS[:4], pa.int64()])], names=["doc_id", "text_number", "start", "stop", "home"])

    own = found.select("doc_id", "text_number", *ranged("start", "stop"), "home", "home_number", *[x.alias(f"home_{n}") for x, n in zip(ranged("home_start", "home_stop"), ("lo", "hi"))], "runs")
    own = own.join(cut_out, ["doc_id", "text_number", "lo", "hi"])
    theirs = cut_out.toDF("home", "home_number", "home_lo", "home_hi", "home_words")
    both = own.join(theirs, ["home", "home_number", "home_lo", "home_hi"])
    return both.select("doc_id", "text_number", "home", "runs", "lo", "words", "home_lo", "home_words").mapInArrow(run, "doc_id long, text_number long, start int, stop int, home long").distinct()


def repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Repeated passages: doc_id, text_number (as told_by_number() gives), start, stop (words), n_words, home_id (a document that keeps a copy of some of it)."""
    with scratch(docs.sparkSession) as keep:
        texts = numbered(docs, keep)
        one = keep(regions(placed(keep(seeds(texts), "seeds"), "shared", keep), True), "regions")
        groups = one.where("seed is not null").select(*[x.split()[0] for x in FOUND.split(", ")])
        two = regions(placed(groups, "shared_groups", keep), False)
        found = keep(one.where("seed is null").select(*NAMES).union(two.select(*NAMES)), "chains")
        spans = passages(found, texts, keep)
        per = Window.partitionBy("doc_id", "text_number").orderBy("start", F.desc("stop"), "home")
        reach = F.max("stop").over(per.rowsBetween(Window.unboundedPreceding, -1))
        marked = spans.withColumn("fresh", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
        marked = marked.withColumn("island", F.sum("fresh").over(per.rowsBetween(Window.unboundedPreceding, 0)))
        out = marked.groupBy("doc_id", "text_number", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("home").alias("home_id")).where(F.col("stop") - F.col("start") >= least)
        return written(out.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "text_number", "start", "stop", (F.col("stop") - F.col("start")).cast("long").alias("n_words"), F.nullif("home_id", F.lit(LAST)).alias("home_id")), "repeats")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("text_number")


_WORD = re.compile((SPACE_CLASS.replace("[", "[^") + "+").encode())


def without(text: bytes, cuts: list[dict]) -> bytes:
    """The text less the stretches from a repeat's first word to its last; what is between stays as it is."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for cut_ in cuts:
        out.append(text[done : at[cut_["start"]][0]])
        done = at[cut_["stop"] - 1][1]
    return b"".join([*out, text[done:]])


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without the words of repeats(); n_chars follows a changed text, and a document with no words left goes.

    Documents meet their cuts once; those without any go through Arrow as they are.
    """
    found = found.groupBy("doc_id", "text_number").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_cuts"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_number").alias("_h"), "_cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            texts = batch.column(1)
            if len(changed):
                made = [without(t.encode(), c).decode() for t, c in zip(texts.take(pa.array(changed)).to_pylist(), batch.column(2).take(pa.array(changed)).to_pylist())]
                mask = np.zeros(batch.num_rows, bool)
                mask[changed] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(made, texts.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2).is_valid(), *batch.columns[3:]], names=["doc_id", "text", "_cut", "lang", "source", "n_chars"])

    keyed, _ = told_by_number(docs)
    both = keyed.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("text_number") == F.col("_h")), "left")
    types = dict(docs.dtypes)
    out = both.select("doc_id", "text", "_cuts", "lang", "source", "n_chars").mapInArrow(run, f"doc_id {types['doc_id']}, text string, _cut boolean, lang {types['lang']}, source {types['source']}, n_chars {types['n_chars']}")
    left = ~F.col("_cut") | F.col("text").rlike(SPACE_CLASS.replace("[", "[^"))
    n_chars = F.when(F.col("_cut"), F.length("text").cast(types["n_chars"])).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", n_chars).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    return without_repeats(docs, repeats(docs))
