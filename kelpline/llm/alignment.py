"""Alignment of two tokenizers' tokens by their bytes, with DuckDB in each Arrow partition.

Each task encodes blocks of texts with both tokenizers and hands DuckDB two interval tables: a
block's tokens in order with the byte at which each ends, texts one after another. An as-of join
finds for each A token the B token that holds its last byte; a range join of the few A tokens
that reach over several B tokens with the B tokens that end inside them gives the other overlaps.
A running sum of common ends numbers the groups. Links are counted by document and id pair there
too.

A block writes one row with its documents (numbers, and their pairs as places in the block's list
of pairs) and a row for each of its pairs with the number of documents that hold it. Spark adds
these partial counts up, takes the highest for each A id (as many rows as the vocabulary at most),
and gives every block the counts of its own pairs alone; so links themselves are never shuffled.

Texts over BLOCK bytes are cut where both tokenizers cut in any case: at a space between ASCII
letters. Nothing of B's vocabulary may then hold a space inside, which is looked up; else such
texts go whole.

Defined results: texts that are null or empty, or whose tokens of A or B don't give the space and
the text's bytes, have no tokens: zeros and an empty groups_sha256; special tokens' strings are plain
text; rows that repeat are documents of their own and count each; a null id stays null; an empty
table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, scratch, table, written
from .packing import IdEncoder

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of the texts that DuckDB aligns at once.
BLOCK = 1 << 20
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

#: Tables a and b: i (place), id, stop (the byte after a token's last one, of all texts of a block in a row); a has doc too.
#: Of each A token the B token that holds its last byte, the first B token that it overlaps, and the groups before it.
SPANS = """
create or replace temp table spans as
select *, coalesce(lag(last_i + common) over (order by i), 0) as first_i, (sum(common) over (order by i rows unbounded preceding) - common)::bigint as g
from (select a.i, a.id, a.doc, b.i as last_i, b.id as last_id, (b.stop = a.stop)::int as common from a asof join b on b.stop >= a.stop)"""
#: Few A tokens overlap B tokens before that one; those B tokens have no common end. A link's key is a number of document, A and B.
LINKS = """
with inner_b as (select b.i, b.id from b anti join (select last_i from spans where common = 1) c on b.i = c.last_i)
select key, count(*) as n from (
  select (doc * $n_a + id) * $n_b + last_id as key from spans
  union all
  select (s.doc * $n_a + s.id) * $n_b + x.id from (select * from spans where first_i < last_i) s join inner_b x on x.i >= s.first_i and x.i < s.last_i)
group by key order by key"""


class Pair:
    """Two tokenizers: ids of texts, and each id's bytes."""

    def __init__(self, byte_bpe: str, pieces: str) -> None:
        a = IdEncoder(byte_bpe)
        a.tokenizer.encode_special_tokens = True
        self.a = a.fast.encode_to_numpy if a.fast else None
        self.slow = a.tokenizer
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab = a.tokenizer.get_vocab()
        entries = [b""] * (max(vocab.values()) + 1)
        for k, v in vocab.items():
            entries[v] = k.encode() if k in a.added else bytes(byte[c] for c in k)
        n, named = self.b.get_piece_size(), self.b.id_to_piece
        self.a_bytes = pa.array(entries, pa.binary())
        self.b_bytes = pa.array([bytes([int(named(i)[3:5], 16)]) if self.b.is_byte(i) else named(i).replace("▁", " ").encode() for i in range(n)], pa.binary())
        self.cuts = not any("▁" in named(i).lstrip("▁") for i in range(n))
        # What a group's text has for each id: A ids after a comma or a group's end, B ids after the bar or a comma.
        self.pieces = pa.array([s + str(i) for s, m in ((",", len(entries)), (";", len(entries)), (",", n), ("|", n)) for i in range(m)], pa.string())
        self.n_a, self.n_b = len(entries), n

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if self.a:
            a = [self.a(" " + t, allowed_special=set(), disallowed_special=()).astype(np.int64) for t in texts]
        else:
            a = [np.array(self.slow.encode(" " + t, add_special_tokens=False).ids, np.int64) for t in texts]
        return a, [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]


_PAIRS: dict[tuple[str, str], Pair] = {}


def units(text: str, cuts: bool, block: int) -> list[str]:
    """The text, or where it is longer than a block its parts; a part's tokens are those of the whole."""
    if not cuts or len(text) <= block:
        return [text]
    out, done = [], 0
    while len(text) - done > block:
        at = _CUT.search(text, done + block)
        if not at:
            break
        out.append(text[done : at.start()])
        done = at.end()
    return [*out, text[done:]]


@dataclass
class Aligned:
    """Of units of text in a row: whether tokens give the bytes, numbers, groups as text after a first sign, and pairs (a << 32 | b) with their links."""

    right: list[bool]
    n_a: list[int]
    n_b: list[int]
    n_groups: list[int]
    groups: list[memoryview]
    keys: list[np.ndarray]
    links: list[np.ndarray]


def _bytes_of(entries: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    got = entries.take(pa.array(ids))
    stops = np.frombuffer(got.buffers()[1], np.int32)[got.offset : got.offset + len(got) + 1]
    return memoryview(got.buffers()[2] or b"").cast("B")[int(stops[0]) : int(stops[-1])], (stops - stops[0])[1:].astype(np.int64)


def _rights(pair: Pair, a: list[np.ndarray], b: list[np.ndarray], want: list[bytes]) -> list[bool]:
    """Whether a unit has bytes and both sides' tokens give them; looked up one by one if all in a row don't."""
    ends = np.cumsum([len(w) for w in want])
    for entries, ids in ((pair.a_bytes, a), (pair.b_bytes, b)):
        data, stops = _bytes_of(entries, np.concatenate(ids))
        if data != b"".join(want) or (np.append(0, stops)[np.cumsum([len(x) for x in ids])] != ends).any():
            return [bool(w) and _bytes_of(pair.a_bytes, x)[0] == w and _bytes_of(pair.b_bytes, y)[0] == w for x, y, w in zip(a, b, want)]
    return [bool(w) for w in want]


def align(pair: Pair, con: duckdb.DuckDBPyConnection, texts: list[str]) -> Aligned:
    none = np.zeros(0, np.int64)
    a, b = pair.encode(texts)
    a, b = ([x if t else none for x, t in zip(side, texts)] for side in (a, b))
    right = _rights(pair, a, b, [(" " + t).encode() if t else b"" for t in texts])
    of = [k for k, r in enumerate(right) if r]
    zero = lambda: [0] * len(texts)
    out = Aligned(right, zero(), zero(), zero(), [memoryview(b"")] * len(texts), [none] * len(texts), [none] * len(texts))
    if not of:
        return out
    size_a, size_b = [len(a[k]) for k in of], [len(b[k]) for k in of]
    ids_a, ids_b = np.concatenate([a[k] for k in of]), np.concatenate([b[k] for k in of])
    con.register("a", pa.table({"i": np.arange(len(ids_a)), "id": ids_a, "stop": _bytes_of(pair.a_bytes, ids_a)[1], "doc": np.repeat(np.arange(len(of)), size_a)}))
    con.register("b", pa.table({"i": np.arange(len(ids_b)), "id": ids_b, "stop": _bytes_of(pair.b_bytes, ids_b)[1]}))
    con.execute(SPANS)
    links = con.execute(LINKS, {"n_a": pair.n_a, "n_b": pair.n_b}).fetchnumpy()
    spans = con.execute("select g, last_i, common from spans order by i").fetchnumpy()
    group_a = spans["g"]
    group_b = np.repeat(np.arange(group_a[-1] + 1), np.diff(spans["last_i"][spans["common"] == 1], prepend=-1))
    # Groups in order, A's tokens before B's: a token's place is its own number and that of the other side's tokens before it.
    place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
    piece = np.empty(len(ids_a) + len(ids_b), np.int64)
    piece[place_a] = ids_a + pair.n_a * (np.diff(group_a, prepend=-1) > 0)
    piece[place_b] = ids_b + 2 * pair.n_a + pair.n_b * (np.diff(group_b, prepend=-1) > 0)
    made = pair.pieces.take(pa.array(piece))
    stops, data = np.frombuffer(made.buffers()[1], np.int32), memoryview(made.buffers()[2]).cast("B")
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    bounds = stops[np.append(0, ends_a + ends_b)].tolist()
    firsts = np.append(0, group_a[ends_a[:-1]]).tolist()
    lasts = (group_a[ends_a - 1] + 1).tolist()
    rest, id_b = np.divmod(links["key"], pair.n_b)
    doc, id_a = np.divmod(rest, pair.n_a)
    at = np.searchsorted(doc, np.arange(len(of) + 1)).tolist()
    keys = id_a << 32 | id_b
    for j, k in enumerate(of):
        out.n_a[k], out.n_b[k], out.n_groups[k] = size_a[j], size_b[j], lasts[j] - firsts[j]
        out.groups[k] = data[bounds[j] : bounds[j + 1]]
        out.keys[k], out.links[k] = keys[at[j] : at[j + 1]], links["n"][at[j] : at[j + 1]]
    return out


def joined(parts: Aligned) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups, groups_sha256, keys and links of one text's units."""
    if not all(parts.right):
        return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    sha = hashlib.sha256(parts.groups[0][1:])
    for more in parts.groups[1:]:
        sha.update(more)
    if len(parts.keys) == 1:
        keys, links = parts.keys[0], parts.links[0]
    else:
        keys, at = np.unique(np.concatenate(parts.keys), return_inverse=True)
        links = np.bincount(at, weights=np.concatenate(parts.links)).astype(np.int64)
    return sum(parts.n_a), sum(parts.n_b), sum(parts.n_groups), sha.hexdigest(), keys, links


DOC = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, n_pairs array<int>, pair array<int>, links array<int>"
DOC_NAMES = [x.split()[0] for x in DOC.split(", ")]
DOC_KINDS = [*[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3]


def blocks(docs: DataFrame, paths: tuple[str, str], block: int = BLOCK) -> DataFrame:
    """block; DOC in one row for each block; and in its other rows place (in the block's pairs), pair (as key), n_docs."""

    def flat(con: duckdb.DuckDBPyConnection, pair: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Documents' rows, block by block."""
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text or "") > block:
                    yield [(doc_id, *long(con, pair, text))]
                    continue
                held.append((doc_id, text or ""))
                size += len(held[-1][1])
                if size > block:
                    yield several(con, pair, held)
                    held, size = [], 0
            if held:
                yield several(con, pair, held)

    def several(con: duckdb.DuckDBPyConnection, pair: Pair, held: list[tuple]) -> list[tuple]:
        got = align(pair, con, [t for _, t in held])
        return [(doc_id, *joined(Aligned(*([v[k]] for v in vars(got).values())))) for k, (doc_id, _) in enumerate(held)]

    def long(con: duckdb.DuckDBPyConnection, pair: Pair, text: str) -> tuple:
        each = [align(pair, con, [u]) for u in units(text, pair.cuts, block)]
        return joined(Aligned(*([v for one in each for v in getattr(one, name)] for name in vars(each[0]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _PAIRS:
            _PAIRS[paths] = Pair(*paths)
        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        names, first = ["block", *DOC_NAMES, "place", "key", "n_docs"], TaskContext.get().partitionId() << 32
        for number, rows in enumerate(flat(con, _PAIRS[paths], batches)):
            key, at, n_docs = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
            cols = [*([r[i] for r in rows] for i in range(5)), [len(r[5]) for r in rows], at.astype(np.int32), np.concatenate([r[6] for r in rows]).astype(np.int32)]
            made = [pa.array([c], t) for c, t in zip(cols, DOC_KINDS)]
            yield pa.RecordBatch.from_arrays([pa.array([first + number]), *made, *[pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.int64())]], names=names)
            if len(key):
                empty = [pa.nulls(len(key), t) for t in DOC_KINDS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), first + number)), *empty, pa.array(np.arange(len(key), dtype=np.int32)), pa.array(key), pa.array(n_docs.astype(np.int64))], names=names)

    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, f"block long, {DOC}, place int, key long, n_docs long")


def summed(rows: DataFrame) -> DataFrame:
    """OUT of blocks (DOC, and found: place, n, best of the block's pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OUT.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, n_a, n_b, n_groups, sha, n_pairs, pair, links, found = (batch.column(j)[k].values for j in range(9))
                counts, best = np.zeros((2, len(found) if found is not None else 0), np.int64)
                if found is not None:
                    place = found.field(0).to_numpy()
                    counts[place], best[place] = found.field(1).to_numpy(), found.field(2).to_numpy(zero_copy_only=False)
                links, pair, upto = links.to_numpy().astype(np.int64), pair.to_numpy(), np.append(0, np.cumsum(n_pairs.to_numpy()))
                of = lambda v: np.diff(np.append(0, np.cumsum(v))[upto])
                n_links, n_best, total = of(links), of(links * best[pair]), of(links * counts[pair])
                yield pa.RecordBatch.from_arrays([doc_id, n_a, n_b, n_groups, *map(pa.array, (n_links, n_best, total)), sha], names=names)

    return rows.select(*DOC_NAMES, "found").mapInArrow(run, OUT)


def alignments(docs: DataFrame, byte_bpe: str, pieces: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """OUT of every row of docs (doc_id, text), and the links of the corpus: a, b, n_docs (documents that hold the pair), best (of its A id)."""
    with scratch(docs.sparkSession) as keep:
        made = keep(blocks(docs, (byte_bpe, pieces), block), "blocks")
        own = made.where("key is not null").select("block", "place", "key", "n_docs")
        counts = keep(own.groupBy("key").agg(F.sum("n_docs").alias("n")), "counts")
        # A row for each A id at most, so of the size of its vocabulary.
        highest = F.broadcast(counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("most")))
        marked = counts.join(highest, F.shiftright("key", 32) == F.col("a")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))
        marked = keep(marked, "marked")
        found = own.join(marked, "key").groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("found"))
        whole = made.where("key is null").select("block", *DOC_NAMES).join(found, "block", "left")
        low = F.col("key").bitwiseAND(0xFFFFFFFF)
        pairs = marked.select(F.shiftright("key", 32).alias("a"), low.alias("b"), F.col("n").alias("n_docs"), "best")
        return written(summed(whole), "aligned"), written(pairs, "pairs")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))[0]
