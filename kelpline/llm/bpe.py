"""Byte-level BPE over whole texts, with the merges found by a segment tree.

The vocabulary is a file of ranks whose path is a parameter. A text is cut by the vocabulary's
pattern; in each match, a segment tree over byte positions holds at its root the leftmost pair
of the lowest rank. A merge joins the pair's right part to its left one and updates the tree
at the two positions whose pairs change and the one that goes, in logarithmic time each. Trees
of short matches of one size are merged together, as rows of one array.

Equal stretches between spaces are encoded once by a worker while they are remembered; what is
remembered is bounded and only saves time.

Defined results: a null text is empty and has no ids; special tokens have no meaning; rows that
repeat are encoded each; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

RANKS = "byte_bpe_50k.tiktoken"
#: Stretches that a worker remembers, of up to so many characters; when there are more, those not met since the last time go.
REMEMBERED, LONGEST = 300_000, 64
NONE = 1 << 62
#: Matches of up to so many bytes are merged together, so many at once.
SHORT, TOGETHER = 64, 4096
#: So few are merged one by one. Texts are encoded together up to about so many characters.
FEW, GROUP = 32, 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the pattern.

    Leaf size + i of the tree holds rank * size + i of the pair that starts at byte position i,
    or NONE; every node holds the lowest of the two below, so the root is the leftmost of the
    lowest rank.
    """
    if piece in ranks:
        return [ranks[piece]]
    n, find = len(piece), ranks.get
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        if (r := find(piece[i : i + 2])) is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n))  # where the part before it starts
    while (low := tree[1]) != NONE:
        i = low & (size - 1)
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        changed = [(gone, NONE)]
        r = find(piece[i : after[end]]) if end < n else None
        changed.append((i, NONE if r is None else r * size + i))
        if (j := before[i]) >= 0:
            r = find(piece[j:end])
            changed.append((j, NONE if r is None else r * size + j))
        for at, key in changed:
            at += size
            if tree[at] == key:
                continue
            tree[at] = key
            while at > 1:
                if tree[at ^ 1] < key:
                    key = tree[at ^ 1]
                at >>= 1
                if tree[at] == key:
                    break
                tree[at] = key
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Trees:
    """The segment trees of merge() for many short matches of one size at once: each has a stretch of one array, and a step makes one merge in every match that has one left.

    A part is an id, so a pair is found among all ways to cut a token into two.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes = np.array([ranks.get(b"%c" % i, -1) for i in range(256)], dtype=np.int64)
        #: Ids and ranks take 20 bits each.
        self.fits = min(self.bytes) >= 0 and max(ranks.values()) < 1 << 20
        ways = {ranks[a] << 20 | ranks[b]: r for token, r in ranks.items() for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks} if self.fits else {}
        self.bits = max(len(ways) * 4, 2).bit_length()
        self.known = np.full(1 << self.bits, -1, dtype=np.int64)
        key = np.fromiter(ways, np.int64, len(ways))
        known, at, self.tries = key << 20 | np.fromiter(ways.values(), np.int64, len(ways)), self.place(key), 1
        while len(known):  # a key lies at its place or a few further on
            free = self.known[at] < 0
            self.known[at[free]] = known[free]
            left = self.known[at] != known
            known, at, self.tries = known[left], at[left] + 1 & (1 << self.bits) - 1, self.tries + 1

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 where there is none."""
        key = a << 20 | b
        at = self.place(key)
        there = self.known.take(at)
        out = np.where(there >> 20 == key, there & 0xFFFFF, -1)
        open_ = np.flatnonzero((there >> 20 != key) & (there >= 0))
        for _ in range(self.tries):
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            there, own = self.known.take(at[open_]), key[open_]
            same = there >> 20 == own
            out[open_[same]] = there[same] & 0xFFFFF
            open_ = open_[~same & (there >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of matches of two bytes or more; each byte is a token."""
        n = np.array([len(p) for p in pieces])
        rows, size = len(pieces), 1 << (int(n.max()) - 1).bit_length()
        ids = self.bytes[np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8)]
        ids[(np.arange(size) >= n[:, None]).ravel()] = -1
        levels = np.full((rows, 2 * size), NONE, dtype=np.int64)
        row, i = np.nonzero(np.arange(size) < n[:, None] - 1)
        r = self.find(ids[row * size + i], ids[row * size + i + 1])
        levels[row, size + i] = np.where(r < 0, NONE, r * size + i)
        level = size
        while level > 1:
            level >>= 1
            np.minimum(levels[:, 2 * level : 4 * level : 2], levels[:, 2 * level + 1 : 4 * level : 2], out=levels[:, level : 2 * level])
        tree = levels.ravel()
        after = np.tile(np.arange(1, size + 2), rows)  # where the part that starts here ends
        before = np.tile(np.arange(-1, size), rows)  # where the part before it starts
        left = np.flatnonzero(levels[:, 1] != NONE)
        while len(left):
            root, text, links = left * (2 * size), left * size, left * (size + 1)
            low = tree.take(root + 1)
            i = low & size - 1
            gone = after.take(links + i)
            end = after.take(links + gone)
            after[links + i] = end
            before[links + end] = i
            own = low // size
            ids[text + i] = own
            ids[text + gone] = -1
            j = before.take(links + i)
            on, back = np.flatnonzero(end < n.take(left)), np.flatnonzero(j >= 0)
            new = np.full(len(left), NONE, dtype=np.int64)
            r = self.find(own[on], ids.take((text + end)[on]))
            new[on] = np.where(r < 0, NONE, r * size + i[on])
            root_back, j = root[back], j[back]
            r = self.find(ids.take(text[back] + j), own[back])
            leaf = root + size
            tree[leaf + gone] = NONE
            tree[leaf + i] = new
            tree[leaf[back] + j] = np.where(r < 0, NONE, r * size + j)
            base, up = np.concatenate([root, root, root_back]), np.concatenate([gone, i, j]) + size
            while up[0] > 1:
                up >>= 1
                below = base + 2 * up
                tree[base + up] = np.minimum(tree.take(below), tree.take(below + 1))
            left = left[tree.take(root + 1) != NONE]
        kept = ids >= 0
        flat, cuts = ids[kept].tolist(), np.append(0, np.cumsum(kept.reshape(rows, size).sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


class Encoder:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = load_ranks(path)
        self.trees = Trees(self.ranks)
        self.names = {i: b"%d" % i for i in self.ranks.values()}
        self.parts = {b"%d" % i: b for b, i in self.ranks.items()}
        self.cut = regex.compile(pattern)
        #: White space after a space belongs to a match across stretches.
        self.entangled = re.compile(r" \s")
        #: Ids and decoded bytes of stretches with the space before them: those met of late, and those of before.
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        #: Ids of matches, after a line's end for those that begin with a space, else after a space.
        self.pieces: dict[str, bytes] = {}

    def merged(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of matches, those of short ones found together."""
        out, sizes = {}, defaultdict(list)
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                out[piece] = self.names[rank]
            elif len(raw) <= SHORT and self.trees.fits:
                sizes[(len(raw) - 1).bit_length()].append((piece, raw))
            else:
                out[piece] = self.named(merge(raw, self.ranks))
        for same in sizes.values():
            for i in range(0, len(same), TOGETHER):
                some = same[i : i + TOGETHER]
                found = self.trees.merge([raw for _, raw in some]) if len(some) > FEW else [merge(raw, self.ranks) for _, raw in some]
                for (piece, _), ids in zip(some, found):
                    out[piece] = self.named(ids)
        return out

    def named(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.names.__getitem__, ids))

    def plain(self, text: str) -> bytes:
        """The ids of a text by all matches of the pattern, each match's after a line's end or a space as in pieces."""
        cut = self.cut.findall(text)
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        known, new = self.pieces, set(cut).difference(self.pieces)
        known.update((p, (b"\n" if p[:1] == " " else b" ") + ids) for p, ids in self.merged(new).items())
        out = b"".join(map(known.__getitem__, cut))
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out

    def alone(self, text: str) -> tuple[bytes, bytes]:
        ids = self.plain(text).replace(b"\n", b" ")[1:]
        return ids, self.decode(ids)

    def learn(self, new: list[str]) -> None:
        """Stretches become known. Each begins with a space, has no other and no white space after it, so matches of all of them in a row end where they do."""
        ids, bytes_ = self.known
        every = self.plain("".join([" " + s for s in new]))
        each = every.split(b"\n")[1:]
        said = self.decode(every.replace(b"\n", b" ")[1:]).split(b" ")[1:]
        if not len(each) == len(said) == len(new):  # another pattern
            each, said = zip(*[self.alone(" " + s) for s in new])
        else:
            said = [b" " + x for x in said]
        ids.update(zip(new, each))
        bytes_.update(zip(new, said))

    def both(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Of each text the decimal ids joined by one space, and the bytes that they decode to."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self.group(some)
                some, size = [], 0
        yield from self.group(some)

    def group(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        split = [[text] if self.entangled.search(text) or text[-1:] == " " else text.split(" ") for text in texts]
        if len(self.known[0]) >= REMEMBERED:
            self.known, self.old = ({}, {}), self.known
        ids, said = self.known
        new = set().union(*[x[1:] for x in split]).difference(ids)
        again = new.intersection(self.old[0])
        for own, old in zip(self.known, self.old):
            own.update((s, old[s]) for s in again)
        new = list(new.difference(again))
        if new:
            self.learn(new)
        out = []
        for first, *rest in split:
            x, y = self.alone(first) if first else (b"", b"")
            found = b" ".join(map(ids.__getitem__, rest))
            out.append((x + b" " + found if x and found else x or found, y + b"".join(map(said.__getitem__, rest))))
        for s in new:
            if len(s) > LONGEST:
                del ids[s], said[s]
        return out

    def encode(self, text: str) -> bytes:
        """The decimal ids joined by one space."""
        return next(self.both([text]))[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids.split(b" "))) if ids else b""


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, which runs several tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids (array of ints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [[int(x) for x in ids.split()] for ids, _ in bpe.both([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids as text and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, decoded = zip(*bpe.both([t or "" for t in part.column(1).to_pylist()]))
                cols = [
                    pa.array([x.count(b" ") + 1 if x else 0 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
