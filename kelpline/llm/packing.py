"""Packing of token ids into windows by minimum bin slack.

A document is cut into whole windows and a tail. Tails are packed by their lengths alone: the
multiset of lengths has at most capacity - 1 members with counts, whatever the input. Each
window starts with the longest length left; a bitset of the sums that the other lengths left
can reach, built length by length, tells how close to capacity it can come, and going back
through the stages gives how many of each length. The same filling repeats while counts last.
Pieces then take the slots of their length by rank. Windows that stay short of capacity are
filled up with pieces of the shortest windows, which are cut for that and dissolved, so that
one window at most is padded.

To the driver go the numbers of pieces by length alone, capacity of them at most. Ranks are
counted in shares of about PER_SHARE pieces, however many there are, and the shares' first ranks
are a table that pieces are joined to. Which pieces share a window depends on how rows lie; how
many windows there are doesn't.

Defined results: a null text is empty and has the end id alone; rows that repeat are packed
each; an empty table gives an empty table; other columns are dropped. A null id ranks first.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import pick, table, written

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
#: Pieces of a share in which ranks within a length are counted, so that neither a length nor a document's repeated rows are a hot spot.
PER_SHARE = 100_000


class IdEncoder:
    """Ids as little-endian 32-bit bytes, as the tokenizer's file has them.

    Where the file is a plain byte-level BPE whose ids follow its merges, its vocabulary goes to
    tiktoken's encoder, which gives the same ids in a sixth of the time; else, and for texts that
    hold an added token, the tokenizers library encodes.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = self._fast(json.load(f))

    def _fast(self, file: dict) -> tiktoken.Encoding | None:
        cut, model = file["pre_tokenizer"] or {}, file["model"]
        plain = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True) and file["normalizer"] is None
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.added}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        first = len(vocab) - len(merged)
        if [vocab.get(m) for m in merged] != list(range(first, len(vocab))):
            return None
        # The printable stand-ins of byte-level vocabularies: bytes that are printable are themselves, the others follow from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


_ENCODERS: dict[str, IdEncoder] = {}


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, tail (binary: a tail's ids, else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = IdEncoder(path)
        encode, end, step = _ENCODERS[path].encode, end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    for a in range(0, len(ids), step):
                        own = ids[a : a + step]
                        out.append((doc_id, a // 4, len(own) // 4, zlib.crc32(own), len(ids) // 4, own if len(own) < step else None))
                kinds = [*[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tail"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tail binary"
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length, of those that counts has, fill room best; bitset subset sums with a stage for each batch of a length."""
    full = (1 << (room + 1)) - 1
    sums, stages = 1, []
    for length in sorted(counts, reverse=True):
        left, batch = min(counts[length], room // length), 1
        while left > 0:  # batches of 1, 2, 4, ... give every number up to the count
            n = min(batch, left)
            stages.append((sums, length, n))
            sums |= (sums << (length * n)) & full
            left, batch = left - n, 2 * batch
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, {}
    for before, length, n in reversed(stages):
        if not before >> at & 1:
            at -= length * n
            out[length] = out.get(length, 0) + n
    return out


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack over all lengths: fillings and how often each is used; counts are used up."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        fill = best_fill({k: v for k, v in rest.items() if v and k <= capacity - longest}, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // n for k, n in fill.items())
        for k, n in fill.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((fill, times))
    return out


def slots_of(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], list[tuple]]:
    """Where pieces go, as runs: slots (length, first rank, in a window, the first window, offset, dissolved, stream, total) and gaps (from, size, the first window).

    A piece of rank first + r goes to window + r // in a window, at offset + length * (r % in a
    window). If the windows are dissolved, it has that offset in the stream of their tokens,
    where they follow one another from `stream` on, `total` apart. Gaps take the stream's tokens
    from `from` on, `size` in each window; the last gap is a run of new windows.
    """
    found = [(fill, times, sum(k * n for k, n in fill.items())) for fill, times in fillings(counts, capacity)]
    found.sort(key=lambda x: -x[2])
    # From the back, windows are dissolved until they fill the gaps of those in front.
    slack = sum((capacity - total) * times for _, times, total in found)
    freed, dissolved = 0, [0] * len(found)
    for i in range(len(found) - 1, -1, -1):
        _, times, total = found[i]
        if total == capacity or freed >= slack:
            break
        # One more window frees its tokens and takes its own gap away: capacity altogether.
        dissolved[i] = min(times, -(-(slack - freed) // capacity))
        freed += dissolved[i] * total
        slack -= dissolved[i] * (capacity - total)
    slots, gaps, used = [], [], {}
    window = stream = filled = 0
    for (fill, times, total), gone in zip(found, dissolved):
        for count, is_gone in ((times - gone, False), (gone, True)):
            if not count:
                continue
            offset = 0
            for length, n in sorted(fill.items(), reverse=True):
                first = used.get(length, 0)
                slots.append((length, first, n, 0 if is_gone else window, offset, is_gone, stream, total))
                used[length] = first + n * count
                offset += length * n
            if is_gone:
                stream += total * count
            else:
                if total < capacity:
                    gaps.append((filled, capacity - total, window))
                    filled += (capacity - total) * count
                window += count
    gaps.append((filled, capacity, window))
    return slots, gaps


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_share: int = PER_SHARE) -> DataFrame:
    """pieces (a written table), as pieces_of() returns them with their row, with sequence_id and offset; some of the tails are cut."""
    spark = pieces.sparkSession
    shares = max(1, -(-pieces.count() // per_share)) * 4
    dealt = pieces.withColumn("_share", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(shares)).cast("int"))
    counts = written(dealt.groupBy("length", "_share").count(), "counts")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots, gaps = slots_of(total, capacity)
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    per: dict[int, list] = {}
    for length, *run in slots:
        per.setdefault(length, []).append(tuple(run))
    gaps = [(a, s, w, b) for (a, s, w), b in zip(gaps, [*(g[0] for g in gaps[1:]), 1 << 62])]
    runs = spark.createDataFrame([(k, v, gaps if any(r[4] for r in v) else []) for k, v in per.items()], "length long, _runs array<struct<first: long, each: long, window: long, at: long, gone: boolean, stream: long, total: long>>, _gaps array<struct<from: long, size: long, window: long, to: long>>")
    order = Window.partitionBy("length", "_share").orderBy("doc_id", "start", "row")
    rank = F.col("_base") + F.row_number().over(order) - 1
    ranked = dealt.join(base.hint("merge"), ["length", "_share"]).withColumn("_rank", rank)
    # A row for each length, capacity at most, so it is broadcast.
    placed = ranked.join(F.broadcast(runs), "length").withColumn("_run", F.element_at(F.filter("_runs", lambda r: r["first"] <= F.col("_rank")), -1))
    nth = F.floor((F.col("_rank") - F.col("_run.first")) / F.col("_run.each")).cast("long")
    at = F.col("_run.at") + F.col("length") * ((F.col("_rank") - F.col("_run.first")) % F.col("_run.each"))
    placed = placed.withColumn("_at", at).withColumn("_nth", nth)
    out = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    stay = placed.where(~F.col("_run.gone")).select(*out, (F.col("_run.window") + F.col("_nth")).alias("sequence_id"), F.col("_at").alias("offset"))

    p = F.col("_run.stream") + F.col("_nth") * F.col("_run.total") + F.col("_at")
    cut = placed.where(F.col("_run.gone")).withColumn("_p", p).withColumn("_q", F.col("_p") + F.col("length"))
    nth_gap = lambda g, x: F.floor((x - g["from"]) / g["size"]).cast("long")
    own = F.filter("_gaps", lambda g: (g["from"] < F.col("_q")) & (g["to"] > F.col("_p")))
    parts = F.transform(own, lambda g: F.transform(F.sequence(nth_gap(g, F.greatest("_p", g["from"])), nth_gap(g, F.least("_q", g["to"]) - 1)), lambda k: F.struct(F.greatest("_p", g["from"] + k * g["size"]).alias("lo"), F.least(F.col("_q"), g["from"] + (k + 1) * g["size"]).alias("hi"), (g["window"] + k).alias("window"), (capacity - g["size"] - g["from"] - k * g["size"]).alias("shift"))))
    cut = cut.withColumn("_part", F.explode(F.flatten(parts))).withColumn("_lo", F.col("_part.lo") - F.col("_p")).withColumn("_n", F.col("_part.hi") - F.col("_part.lo"))
    ids = F.substring("tail", (4 * F.col("_lo") + 1).cast("int"), (4 * F.col("_n")).cast("int"))
    cut = cut.select("doc_id", (F.col("start") + F.col("_lo")).alias("start"), F.col("_n").alias("length"), F.crc32(ids).alias("ids_crc32"), "doc_tokens", F.col("_part.window").alias("sequence_id"), (F.col("_part.lo") + F.col("_part.shift")).alias("offset"))
    return stay.unionByName(cut)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Written once: pieces are counted first and placed after.
    return pack(written(pieces_of(docs, public_tokenizers.path(TOKENIZER)).withColumn("row", F.monotonically_increasing_id()), "pieces"))
