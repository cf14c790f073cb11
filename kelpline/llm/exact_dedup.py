"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is its bytes' polynomial in LANES bases modulo LANES primes. Chunks are
hashed apart, and hashes join by arithmetic: of left || right, left * base^len(right) + right.
Texts of more than PIECE bytes are cut into pieces that tasks hash in parallel, each shifted by
the bytes after it, so that a text's fingerprint is the pieces' sum.

Texts whose fingerprints and lengths are equal are then compared, chunk by chunk, with one of
them; where texts differ after all, their group is split by SHA-256 and compared again. Only texts
that may be in a group are shuffled: tasks look fingerprints up in a bit for each group's hash, of
which there are 16 for a group and FILTER_BITS at most (beyond that more texts pass, and none is
missed). Texts over PIECE bytes are compared piece by piece, in several tasks. A group of more than
2^-14 of all rows is dealt to several tasks before anything of it is shuffled; each compares its
share with one text, and these texts are then compared with each other.

Defined results: texts are equal when they are after lower-casing A-Z; null counts as empty;
of equal texts the row with the largest id stays, null ids being smallest; of rows that repeat
with that id, one stays; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, keep_rows, pick, scratch, table, written

CHUNK = 4096
#: Primes under 2^31 and a base for each. Sums of CHUNK products of a byte and a power stay under 2^53.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003, 754974721, 1234567891, 998244353)
#: Bytes of a piece, and the share of all rows (and number) above which a group is dealt to several tasks; there are 1 / HOT of these groups at most.
PIECE, HOT, PER_TASK = 1 << 20, 2.0**-14, 256
KEY = ("f1", "f2", "n_bytes", "split")
#: 8 MiB.
FILTER_BITS = 1 << 26


class Fingerprinter:
    """Polynomial hashes in several lanes; moduli are a parameter so that tests can make them collide."""

    def __init__(self, moduli: tuple[int, ...] = MODULI) -> None:
        self.moduli = np.array(moduli, dtype=np.uint64)
        powers = [[pow(b, CHUNK - 1 - i, m) for b, m in zip(BASES, moduli)] for i in range(CHUNK)]
        self.powers = np.array(powers, dtype=np.float64)

    def chunk(self, data: np.ndarray) -> np.ndarray:
        """Of up to CHUNK bytes. Exact: every sum is an integer under 2^53."""
        return (data.astype(np.float64) @ self.powers[CHUNK - len(data) :]).astype(np.uint64) % self.moduli

    def shift(self, length: int) -> np.ndarray:
        return np.array([pow(b, length, int(m)) for b, m in zip(BASES, self.moduli)], dtype=np.uint64)

    def combine(self, left: np.ndarray, right: np.ndarray, right_length: int) -> np.ndarray:
        return (left * self.shift(right_length) % self.moduli + right) % self.moduli

    def text(self, data: bytes) -> tuple[int, int]:
        raw = np.frombuffer(data, dtype=np.uint8)
        first = len(raw) % CHUNK
        out = self.chunk(raw[:first])
        if len(raw) > first:
            whole = raw[first:].reshape(-1, CHUNK)
            step = self.shift(CHUNK)
            for i in range(0, len(whole), 256):  # a bounded piece of a huge text at a time
                for h in (whole[i : i + 256].astype(np.float64) @ self.powers).astype(np.uint64) % self.moduli:
                    out = (out * step % self.moduli + h) % self.moduli
        return self.joined(out)

    @staticmethod
    def joined(lanes: np.ndarray) -> tuple[int, int]:
        a, b, c, d = (int(x) for x in lanes)
        return a << 31 | b, c << 31 | d

    def lanes(self, data: bytes) -> np.ndarray:
        a, b = self.text(data)
        return np.array([a >> 31, a & 0x7FFFFFFF, b >> 31, b & 0x7FFFFFFF], dtype=np.uint64)


PRINT = "doc_id long, text_hash long, row long, f1 long, f2 long, n_bytes long, text_sha256 string"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))


def fingerprints(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame], moduli: tuple[int, ...] = MODULI, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """PRINT of all rows, text_sha256 in lower-case hex; and of texts over piece bytes PRINT with at and body (lower-cased) of their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(moduli)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, text_hash, text, row in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns)):
                    body = (text or b"").translate(LOWER_BYTES)
                    head = (doc_id, text_hash, row, len(body), hashlib.sha256(body).hexdigest())
                    if len(body) <= piece:
                        rows.append((*head, *prints.text(body), None, None))
                    else:
                        rows += [(*head, None, None, j, body[j : j + piece]) for j in range(0, len(body), piece)]
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "text_hash", "row", "n_bytes", "text_sha256", "f1", "f2", "at", "body"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(moduli)
        for batch in batches:
            rest = batch.drop_columns(["at", "body"])
            after = [n - at - len(b) for n, at, b in zip(batch.column("n_bytes").to_pylist(), batch.column("at").to_pylist(), batch.column("body").to_pylist())]
            lanes = [prints.lanes(b) * prints.shift(k) % prints.moduli for b, k in zip(batch.column("body").to_pylist(), after)]
            cols = np.array(lanes, dtype=np.uint64).reshape(-1, len(moduli)).astype(np.int64).T
            yield pa.RecordBatch.from_arrays([*rest.columns, *map(pa.array, cols)], names=[*rest.schema.names, *"abcd"])

    head = ["doc_id", "text_hash", "row", "n_bytes", "text_sha256"]
    kinds = "doc_id long, text_hash long, row long, n_bytes long, text_sha256 string"
    found = keep(_rows(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, kinds + ", f1 long, f2 long, at long, body binary"), "hashed")
    pieces = found.where("at is not null").select(*head, "at", "body").repartition("row", "at").mapInArrow(hashed, kinds + ", a long, b long, c long, d long")
    lane = lambda c, m: F.pmod(F.sum(c), F.lit(m))
    whole = pieces.groupBy(*head).agg(*[lane(c, m).alias(c) for c, m in zip("abcd", moduli)])
    both = lambda x, y: F.shiftleft(x, 31).bitwiseOR(F.col(y))
    whole = whole.withColumns({"f1": both("a", "b"), "f2": both("c", "d")})
    names = [x.split()[0] for x in PRINT.split(", ")]
    whole = keep(whole.select(*names), "long_prints")
    pieces = found.where("at is not null").select("row", "at", "body").join(whole, "row")
    return found.where("at is null").select(*names).union(whole), pieces


def group_bits(groups: DataFrame) -> np.ndarray:
    """A bit for f1 of each group of two or more, by its last binary digits; a power of two of bits, as words of 64."""
    several = groups.where("group_size > 1")
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * several.count()).bit_length()))
    place = F.col("f1").bitwiseAND(bits - 1)
    words = several.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def differing(docs: DataFrame, pieces: DataFrame, hot: dict[tuple, int], grouped: np.ndarray | None, by_sha: set[tuple] | None = None, moduli: tuple[int, ...] = MODULI, piece: int = PIECE) -> DataFrame:
    """The keys (KEY) of groups that hold different texts.

    pieces: as fingerprints() gives them, of texts over piece bytes. hot: in how many shares a key is dealt. grouped: group_bits(). by_sha: keys (f1, f2, n_bytes) whose groups are split by SHA-256, if known to be some; others aren't looked at then.
    """
    names, schema = [*KEY, "at", "share", "body"], "f1 long, f2 long, n_bytes long, split string, at long, share int, body binary"
    kinds = [*[pa.int64()] * 3, pa.string(), pa.int64(), pa.int32(), pa.binary()]

    def wanted(key: tuple) -> bool:
        if by_sha is not None:
            return key in by_sha
        place = key[0] & (len(grouped) * 64 - 1)
        return int(grouped[place >> 6]) >> (place & 63) & 1 == 1

    def row(key: tuple, sha: str, doc_id: int | None, text_hash: int, at: int, body: bytes) -> tuple:
        key = (*key, sha if by_sha else "")
        return (*key, at, ((doc_id or 0) * 31 + text_hash) % hot.get(key, 1), body)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=names)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(moduli)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns)):
                    body = (text or b"").translate(LOWER_BYTES)
                    key = (*prints.text(body), len(body)) if len(body) <= piece else None
                    if key and wanted(key):
                        rows.append(row(key, hashlib.sha256(body).hexdigest() if by_sha else "", doc_id, text_hash, 0, body))
                yield batch_of(rows)

    def long_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                of = zip(*(batch.slice(i, 16).column(c).to_pylist() for c in ("f1", "f2", "n_bytes", "text_sha256", "doc_id", "text_hash", "at", "body")))
                yield batch_of([row((f1, f2, n), *rest) for f1, f2, n, *rest in of if wanted((f1, f2, n))])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each key that differs, without body, and for each share of a hot key one with its text."""
        at, first, told = None, b"", False
        for batch in batches:
            out = []
            keys, body = list(zip(*(batch.column(i).to_pylist() for i in range(6)))), batch.column(6)
            for i, key in enumerate(keys):
                text = memoryview(body[i].as_buffer()).cast("B")
                if key != at:
                    at, first, told = key, bytes(text), False
                    if hot.get(key[:4], 1) > 1:
                        out.append((*key[:5], first))
                elif not told and any(text[j : j + CHUNK] != first[j : j + CHUNK] for j in range(0, len(first), CHUNK)):
                    told = True
                    out.append((*key[:5], None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, [*kinds[:5], pa.binary()])], names=[*KEY, "at", "body"])

    both = _rows(docs).mapInArrow(bodies, schema).union(pieces.mapInArrow(long_bodies, schema))
    dealt = both.repartition(*KEY, "at", "share").sortWithinPartitions(*KEY, "at", "share")
    found = dealt.mapInArrow(compared, "f1 long, f2 long, n_bytes long, split string, at long, body binary")
    # Of each hot key's piece a text for each share is left: they are equal if they have one value.
    found = found.groupBy(*KEY, "at").agg(F.bool_or(F.col("body").isNull()).alias("differ"), F.min("body").alias("lo"), F.max("body").alias("hi"))
    return found.where("differ or lo <> hi").select(*KEY).distinct()


def exact_duplicates(docs: DataFrame, moduli: tuple[int, ...] = MODULI, piece: int = PIECE, per_task: int = PER_TASK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, text_hash."""
    docs = pick(docs, "doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        prints, pieces = fingerprints(docs, keep, moduli, piece)
        prints = keep(prints.withColumn("split", F.lit("")), "prints")
        grouped = lambda p, name: keep(p.groupBy(*KEY).agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), name)
        n = prints.count()

        def hot(groups: DataFrame) -> dict[tuple, int]:
            most = max(per_task, int(n * HOT))
            return {(r.f1, r.f2, r.n_bytes, r.split): -(-r.group_size // most) for r in groups.where(F.col("group_size") > most).collect()}

        groups = grouped(prints, "groups")
        bad = keep(differing(docs, pieces, hot(groups), group_bits(groups), None, moduli, piece), "bad")
        if not bad.isEmpty():
            plain = bad.drop("split").withColumn("bad", F.lit(True))
            prints = keep(prints.join(plain, ["f1", "f2", "n_bytes"], "left").withColumn("split", F.when(F.col("bad"), F.col("text_sha256")).otherwise("")).drop("bad"), "split_prints")
            groups = grouped(prints, "split_groups")
            # Keys that meet for different texts: of 124 bits there are none, so they are few.
            if not differing(docs, pieces, hot(groups), None, {tuple(r) for r in plain.drop("bad").collect()}, moduli, piece).isEmpty():
                raise ValueError("texts differ that have one SHA-256")
        out = prints.join(groups, list(KEY))
        return written(out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", "text_hash"), "exact")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    return keep_rows(docs, exact_duplicates(docs))


OP10_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents),
g as (
  select *, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256)::bigint as group_size,
         row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept
  from d)
select doc_id, keep_id, group_size, kept, text_sha256 from g
"""
