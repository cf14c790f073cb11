"""Repeated byte strings by distributed prefix doubling.

A position's rank says which strings begin there alike: positions have one rank if their next h
bytes are equal. Ranks of 2 h bytes are ranks of pairs (the rank of the first h, that of the h
after them): Spark sorts the distinct pairs, numbers them and joins the numbers back, at offsets
that double until they reach LENGTH. A position whose pair no other one has is unique and goes;
one that is left at LENGTH begins a string that is found elsewhere too.

Positions enter the sort where they can matter only. The gram of SHARED bytes with the least hash
in a window of LENGTH bytes (the leftmost of equals) is a function of the window's bytes, so
windows are equal only where these grams are. Neighbouring windows with one such place form a
stretch of up to LENGTH - SHARED + 1 positions. Stretches whose gram is at no other place are
unique as a whole, stretches whose bytes (LENGTH at least) are found twice as a whole are past
the threshold, both without a sort of their positions; what is left are the stretches at the ends
of what repeats, and one of each lot of equal ones that shares its gram with others. The position's
second rank at an offset isn't always a row then, so the bytes there stand for it by their digest.

Digests have 96 bits. Hot strings are counted in the tasks that read them before anything is
shuffled, and joined as plain written tables, which adaptive execution splits. Rows are known by a
number in a written table and not by their ids or texts.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; rows that repeat
are texts of their own, and all lose what they share, none keeps a copy; a null id stays null; an
empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick, scratch, table, written

LENGTH, SHARED = 400, 340
#: First h of the doubling; LENGTH / FIRST is a power of two.
FIRST = 100
#: Bytes of a digest: two of a million million strings agree by chance once in 10^5 corpora.
DIGEST = 12
#: Positions of a text that are hashed at once; places in it take as many bits of a key.
PART, PLACE_BITS = 1 << 22, np.uint64(24)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240713).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def grams(raw: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes; equal runs have equal ones, and others seldom."""
    up, down = power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(raw) - k + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def least(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by running minima from both ends of blocks of w."""
    n = len(keys) - w + 1
    blocks = np.full(-(-len(keys) // w) * w, ~np.uint64(0))
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def stretches(text: bytes, length: int = LENGTH, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, stop (positions of windows) and gram of a text's stretches, in order."""
    out: list[tuple[np.ndarray, ...]] = []
    raw, w = np.frombuffer(text, np.uint8), length - shared + 1
    for a in range(0, len(raw) - length + 1, PART):
        h = grams(raw[a : a + PART + length - 1], shared)
        place = np.arange(len(h), dtype=np.uint64)
        best = least(h >> PLACE_BITS << PLACE_BITS | place, w) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))
        starts = np.append(0, np.flatnonzero(np.diff(best.astype(np.int64))) + 1)
        out.append((starts + a, np.append(starts[1:], len(best)) + a, h[best[starts].astype(np.int64)].view(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def _table(batch_rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Tuples of equally long columns, as batches of about 100,000 rows."""
    held: list[tuple] = []
    size = 0
    for cols in batch_rows:
        held.append(cols)
        size += len(cols[0])
        if size >= 100_000:
            yield _joined(held, kinds, names)
            held, size = [], 0
    if held:
        yield _joined(held, kinds, names)


def _joined(held: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = [np.concatenate(c) if isinstance(c[0], np.ndarray) else [v for part in c for v in part] for c in zip(*held)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def all_stretches(texts: DataFrame, length: int, shared: int) -> DataFrame:
    """row, start, stop, gram of texts (row, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for row, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    start, stop, gram = stretches(memoryview(body.as_buffer()), length, shared)
                    if len(start):
                        yield np.full(len(start), row), start, stop, gram

        return _table(each(), [pa.int64()] * 4, ["row", "start", "stop", "gram"])

    return texts.where(F.length("body") >= length).select("row", "body").mapInArrow(run, "row long, start long, stop long, gram long")


def digested(bodies: DataFrame, length: int) -> DataFrame:
    """row, start, stop, gram and whole (the digest of the stretch's bytes) of bodies (row, body, parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for row, body, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    text = memoryview(body.as_buffer())
                    start, stop, gram = (parts.values.field(i).to_numpy() for i in range(3))
                    yield np.full(len(start), row), start, stop, gram, [digest(text[a : b - 1 + length]) for a, b in zip(start.tolist(), stop.tolist())]

        return _table(each(), [*[pa.int64()] * 4, pa.binary()], ["row", "start", "stop", "gram", "whole"])

    return bodies.select("row", "body", "parts").mapInArrow(run, "row long, start long, stop long, gram long, whole binary")


def positions(bodies: DataFrame, wanted: DataFrame, length: int, first: int) -> DataFrame:
    """row, at, places (of the stretch) and a digest of every step of the doubling: d0 of the first bytes, d1 of as many after them, d2 of twice as many, ...

    wanted: row, parts (start, stop, places).
    """
    steps = [(0, first)]
    while steps[-1][1] < length:
        steps.append((steps[-1][1], min(2 * steps[-1][1], length)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for row, body, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    text = memoryview(body.as_buffer())
                    for a, b, places in zip(*(parts.values.field(i).to_pylist() for i in range(3))):
                        yield np.full(b - a, row), np.arange(a, b), np.full(b - a, places), *[[digest(text[p + lo : p + hi]) for p in range(a, b)] for lo, hi in steps]

        return _table(each(), [*[pa.int64()] * 3, *[pa.binary()] * len(steps)], ["row", "at", "places", *[f"d{i}" for i in range(len(steps))]])

    both = bodies.select("row", "body").join(wanted, "row").select("row", "body", "parts")
    return both.mapInArrow(run, "row long, at long, places long, " + ", ".join(f"d{i} binary" for i in range(len(steps))))


def doubled(rows: DataFrame, keep: Scratch) -> DataFrame:
    """row and at of the positions() that are not unique at the last offset and whose own stretch is.

    Each turn sorts the distinct pairs that several places have, numbers them and joins the numbers
    back: the ranks of the next turn, whose strings are twice as long. A turn's tables go when the
    next one's are written.
    """
    digests = [c for c in rows.columns if c[0] == "d"]
    ranked, done = keep(rows, "positions").withColumn("rank", F.lit(0).cast("long")), ["positions"]
    for i, d in enumerate(digests):
        pairs = ranked.groupBy("rank", d).agg(F.sum("places").alias("n")).where("n > 1").drop("n")
        pairs = keep(pairs.repartitionByRange("rank", d).sortWithinPartitions("rank", d).withColumn("next", F.monotonically_increasing_id()), f"ranks_{i}")
        left = ["row", "at", "places", *digests[i + 1 :]]
        ranked = ranked.join(pairs, ["rank", d]).select(*left, F.col("next").alias("rank"))
        ranked = keep(ranked, f"ranked_{i}")
        keep.drop(*done)
        done = [f"ranks_{i}", f"ranked_{i}"]
    return ranked.where("places = 1").select("row", "at")


def removed(batch_spans: list[tuple[int, int]]) -> list[list[int]]:
    """Spans of bytes, joined where they meet."""
    out: list[list[int]] = []
    for a, b in sorted(batch_spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def shortened(bodies: DataFrame, length: int) -> DataFrame:
    """RESULT and spans (start, stop in bytes) of bodies (doc_id, body, cuts: start and stop of windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")] + ["spans"]
        kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        for batch in batches:
            rows = []
            for doc_id, body, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = memoryview(body.as_buffer())
                spans = removed([(a, b - 1 + length) for a, b in zip(*(cuts.values.field(i).to_pylist() for i in range(2)))])
                sha, done = hashlib.sha256(), 0
                for a, b in spans:
                    sha.update(text[done:a])
                    done = b
                sha.update(text[done:])
                rows.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), sha.hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=names)

    return bodies.select("doc_id", "body", "cuts").mapInArrow(run, f"{RESULT}, spans array<struct<start: long, stop: long>>")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, shared: int = SHARED, first: int = FIRST) -> DataFrame:
    """RESULT and spans (of bytes removed, in order) of every row of docs (doc_id, text)."""
    with scratch(docs.sparkSession) as keep:
        texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
        texts = keep(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
        heads = keep(texts.select("row", "doc_id", F.length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha")), "heads")
        found = keep(all_stretches(texts, length, shared), "stretches")
        twice = keep(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
        parts = found.join(twice, "gram").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "gram"))).alias("parts"))
        parts = keep(parts, "parts")
        keep.drop("stretches", "grams")
        bodies = keep(texts.join(parts, "row").select("row", "doc_id", "body", "parts"), "bodies")
        keep.drop("texts", "parts")

        places = keep(digested(bodies, length), "places")
        kinds = keep(places.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("row", "start", "stop")).alias("one")), "kinds")
        whole = keep(places.join(kinds.where("places > 1").select("gram", "whole"), ["gram", "whole"]).select("row", "start", "stop"), "whole")
        keep.drop("places")
        # Of a gram whose stretches are all equal no position needs a rank.
        several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
        wanted = kinds.join(several, "gram").groupBy("one.row").agg(F.collect_list(F.struct("one.start", "one.stop", "places")).alias("parts"))
        alike = doubled(positions(bodies, keep(wanted, "wanted"), length, first), keep)

        cuts = whole.union(alike.select("row", "at", F.col("at") + 1)).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
        cuts = keep(cuts, "cuts")
        changed = shortened(bodies.join(cuts, "row"), length)
        none = F.lit(0).cast("long")
        same = heads.join(cuts.select("row"), "row", "left_anti").select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.array().cast("array<struct<start: long, stop: long>>").alias("spans"))
        return written(changed.union(same), "suffix_dedup")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")
