"""Language-model scores from a causal self-attention model on subword ids, trained here in numpy.

A text is its words (stretches without space or controls 9 to 13, A-Z in lower case) and one
end. Words are cut to the subword ids of a public vocabulary. The model gives a word's subwords
and the end one after another: P(subword) = P(its class | context) * P(subword | class, the one
before). The class comes from one layer of masked self-attention over the CONTEXT to CONTEXT +
STRIDE - 1 subwords before, on top of how often classes follow the one before; the second factor
is counted. All counts, and the company that subwords keep, are of the whole training corpus.

Windows overlap: each has CONTEXT subwords that give context alone and STRIDE that are scored,
so every subword is scored once, in batches. Embeddings are the main directions of the company that
subwords keep; attention and what follows it train on all windows of all training texts, where all places of each are predicted (`places`: so many of them, chosen by chance).
Training texts are dealt to shards of about SHARD subwords by a hash of id and text, so that the
weights don't depend on how rows lie in partitions; in each of ROUNDS rounds a shard trains on
its share of that round's texts, one after another, and what the shards get is averaged.

To the driver go tables whose size the vocabulary and constants bound: subword counts, words with
at least a 2 ** -20 share of all (so 2 ** 20 at most), pairs of subwords if there are PAIRS at most
(else words meet them in joins), and the weights, summed by a tree. Rarer words meet their counts
in one shuffle; each has less than that share of the rows.

Defined results: a null text is empty and has the end alone; null ids are not held out; rows
that repeat are scored, and counted, each; with no training texts all counts are 0 and the
model is uniform over its classes; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, pick, scratch, table, written

RANKS = "byte_bpe_50k.tiktoken"
STRIDE, CONTEXT, DIM = 16, 16, 16
SPAN = STRIDE + CONTEXT
#: Classes: the end, classes that begin a word, classes that go on with one; the last of each is for subwords without an embedding of their own.
BEGIN, GO_ON = 31, 32
CLASSES = 1 + BEGIN + GO_ON
#: Numbers that sum up the company a subword keeps.
SKETCH, PACK = 32, 2.0**26
#: Subwords with an embedding of their own; the rest share HASHED ones by their ids.
OWN, HASHED = 2816, 255
END_AT, PAD = OWN + HASHED, OWN + HASHED + 1
BUCKETS = PAD + 1
#: Words with this share of all are kept apart; there are 1 / SHARE of them at most.
SHARE = 2.0**-20
#: Pairs of subwords that go to every task as a table; more of them are joined.
PAIRS = 1 << 20
#: Passes with an average after each, subwords of a shard, predicted places of a training window, predicted places in a step.
ROUNDS, SHARD, PLACES, BATCH, RATE = 3, 2_000_000, STRIDE, 2048, 0.015
#: Parts of a sum that one task takes in.
FAN = 16
#: Added to subword counts within a class; weight of a class's counts beside those after the subword before; of class shares.
ADDED, BACK, PRIOR = 0.1, 20.0, 20.0
HELD = 10
_LN10 = float(np.log(10))


class Subwords:
    """Subword ids of words by a tiktoken file of ranks; `end` is the id after the last."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.end = max(self.ranks.values()) + 1
        self.coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Of all words in order, each with a space before it."""
        if not words:
            return np.zeros(0, np.int64)
        return np.array(self.coding.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), dtype=np.int64)

    def parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        ids = self.ids(words)
        at = np.flatnonzero(self.begins()[ids])
        if len(at) != len(words) or len(at) and at[0]:  # odd white space in a word
            each = [self.ids([w]) for w in words]
            return np.concatenate([np.zeros(0, np.int64), *each]), np.array([len(x) for x in each], dtype=np.int64)
        return ids, np.diff(np.append(at, len(ids)))

    @cache
    def begins(self) -> np.ndarray:
        """Per id, whether it begins a word."""
        out = np.zeros(self.end + 1, dtype=bool)
        out[[i for b, i in self.ranks.items() if b[:1] == b" "]] = True
        return out


_SUBWORDS: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """One for each worker process, which runs several tasks."""
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_BYTES).split()


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(HELD)) == 0, F.lit(False))


# --- counts of the corpus


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n (in all texts), c (in training texts); ends are not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            held, train = both
            words = list({**train, **held})
            cols = [pa.array(words, pa.binary()), pa.array([train[w] + held[w] for w in words], pa.int64()), pa.array([train[w] for w in words], pa.int64())]
            held.clear()
            train.clear()
            return pa.RecordBatch.from_arrays(cols, names=["word", "n", "c"])

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for text, train in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    both[train].update(words_of(text))
                if len(both[0]) + len(both[1]) > 500_000:
                    yield out()
        yield out()

    texts = docs.select(F.col("text").cast("binary"), (~held_out()).cast("int").alias("train"))
    return texts.mapInArrow(run, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def subword_counts(words: DataFrame, path: str) -> DataFrame:
    """kind, a, b, n of word_counts(): 0: words begin with a; 1: a goes on with a word; 2: words end with a; 3: b follows a in a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path)
        total: dict[int, int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                rows = [(sub.ids([w]), c) for w, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if c]
                if not rows:
                    continue
                n = np.array([len(ids) for ids, _ in rows])
                ids, c = np.concatenate([ids for ids, _ in rows]), np.repeat([c for _, c in rows], n)
                ends = np.cumsum(n) - 1
                first = np.zeros(len(ids), dtype=bool)
                first[ends - n + 1] = True
                inner = np.flatnonzero(~first)
                keys = [ids[first], (1 << 40) | ids[inner], (2 << 40) | ids[ends], (3 << 40) | (ids[inner - 1] << 20) | ids[inner]]
                keys, at = np.unique(np.concatenate(keys), return_inverse=True)
                sums = np.bincount(at, np.concatenate([c[first], c[inner], c[ends], c[inner]]))
                for k, v in zip(keys.tolist(), sums.astype(np.int64).tolist()):
                    total[k] = total.get(k, 0) + v
        key = np.fromiter(total, np.int64, len(total))
        kind, low = key >> 40, key & ((1 << 40) - 1)
        pair = kind == 3
        cols = [kind, np.where(pair, low >> 20, low), np.where(pair, low & 0xFFFFF, 0), np.fromiter(total.values(), np.int64, len(total))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "a", "b", "n"])

    return words.select("word", "c").mapInArrow(run, "kind long, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


class Counts:
    """What is counted of subwords, ready for look-ups: buckets, classes, chances within a class and class shares."""

    def __init__(self, begins: np.ndarray, first: np.ndarray, inner: np.ndarray, last: np.ndarray, n_docs: int) -> None:
        """first, inner, last: counts per id; ids end with that of the end."""
        end = len(begins) - 1
        self.begins, self.first, self.inner, self.last, self.n_docs = begins, first, inner, last, n_docs
        self.count = (first + inner).astype(float)
        self.order = np.lexsort((np.arange(end), -self.count[:end]))
        self.bucket = (OWN + np.arange(end + 1) * 40503 % HASHED).astype(np.int32)
        self.bucket[self.order[:OWN]] = np.arange(min(OWN, end))
        self.bucket[end] = END_AT

    def classify(self, vectors: np.ndarray) -> None:
        """Classes are clusters of the vectors of OWN subwords; then the chances in them."""
        begins, count, order = self.begins, self.count, self.order
        end = len(begins) - 1
        self.cls = np.zeros(end + 1, dtype=np.int32)
        self.within = np.zeros(end + 1)  # log P(subword | class)
        for kind, n, base in ((begins[:end], BEGIN, 1), (~begins[:end], GO_ON, 1 + BEGIN)):
            self.cls[:end][kind] = base + n - 1
            ids = order[:OWN][kind[order[:OWN]]]
            if len(ids):
                self.cls[ids] = base + clusters(vectors[self.bucket[ids]], np.sqrt(count[ids] + ADDED), n - 1)
        total = np.bincount(self.cls[:end], count[:end] + ADDED, minlength=CLASSES)
        self.within[:end] = np.log((count[:end] + ADDED) / total[self.cls[:end]])

    def follow(self, inside: np.ndarray) -> None:
        """Shares of classes after each bucket, from how often they go on with a word (buckets, classes) and how words and texts begin."""
        end = len(self.begins) - 1
        start = np.bincount(self.cls[:end], self.first[:end], minlength=CLASSES)
        start[0] = self.n_docs
        go = np.bincount(self.cls[:end], self.inner[:end], minlength=CLASSES)
        closed = np.bincount(self.bucket[:end], self.last[:end], minlength=BUCKETS)
        closed[END_AT] = self.n_docs
        norm = lambda x: x / max(x.sum(), 1)
        follow = inside + closed[:, None] * norm(start) + PRIOR * norm(start + go + 1)
        self.prior = np.log(follow / follow.sum(axis=1, keepdims=True)).astype(np.float32)


class Pairs:
    """log P(subword | its class, the one before) by look-up in all counted pairs."""

    def __init__(self, pairs: np.ndarray, cls: np.ndarray, within: np.ndarray) -> None:
        """pairs: rows (a, b, n)."""
        a, b, n = pairs[:, 0], pairs[:, 1], pairs[:, 2].astype(float)
        self.cls, self.within, key = cls, within, a << 20 | b
        by_key = np.argsort(key)
        self.keys, n = key[by_key], n[by_key]
        self.class_keys, of = np.unique((a * CLASSES + cls[b])[by_key], return_inverse=True)
        n_class = np.bincount(of, n, minlength=len(self.class_keys))
        self.log_back = np.log(BACK / (n_class + BACK))
        self.log_pair = np.log((n + BACK * np.exp(within[b[by_key]])) / (n_class[of] + BACK))

    def logs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = self.within[b]
        if not len(self.keys):
            return out
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        kept = self.keys[at] == key
        # A pair that isn't there leaves what its class has left after this subword.
        key = a * CLASSES + self.cls[b]
        of = np.minimum(np.searchsorted(self.class_keys, key), len(self.class_keys) - 1)
        out = out + np.where(self.class_keys[of] == key, self.log_back[of], 0.0)
        out[kept] = self.log_pair[at[kept]]
        return out


def clusters(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Weighted k-means by cosine, started from the heaviest rows that are far apart; the cluster of each row."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = [int(weight.argmax())]
    near = x @ x[centre[0]]
    for _ in range(min(k, len(x)) - 1):
        centre.append(int(((1 - near).clip(0) * weight).argmax()))
        near = np.maximum(near, x @ x[centre[-1]])
    mid = x[centre]
    for _ in range(rounds):
        own = (x @ mid.T).argmax(axis=1)
        mid = np.zeros_like(mid)
        np.add.at(mid, own, x * weight[:, None])
        mid /= np.maximum(np.linalg.norm(mid, axis=1, keepdims=True), 1e-9)
    return own


def company(seqs: Iterator[list[np.ndarray]], bucket: np.ndarray) -> np.ndarray:
    """Per bucket the sum of random vectors of the subwords that are within SPAN neighbours with it; every subword is in one such stretch. Whole numbers, so the order of sums doesn't matter."""
    random = np.random.default_rng(11).integers(-8, 9, size=(BUCKETS, SKETCH)).astype(np.float32)
    random[PAD] = 0
    out = np.zeros((BUCKETS, SKETCH))
    for some in seqs:
        n = np.array([len(s) for s in some])
        sizes = -(-n // SPAN) * SPAN
        if not sizes.sum():
            continue
        b = np.full(sizes.sum(), PAD, dtype=np.int64)
        b[np.repeat(np.cumsum(sizes) - sizes - np.cumsum(n) + n, n) + np.arange(n.sum())] = bucket[np.concatenate(some)]
        for i in range(0, len(b), SPAN * 1024):
            own = b[i : i + SPAN * 1024]
            sums = random[own].reshape(-1, SPAN, SKETCH).sum(axis=1).astype(float)
            # Two sums at a time in one number: each is less than half of PACK, as 1024 stretches give 2 ** 23 at most.
            sums = sums[:, ::2] + PACK * sums[:, 1::2]
            for j in range(SKETCH // 2):
                both = np.bincount(own, np.repeat(sums[:, j], SPAN), minlength=BUCKETS)
                high = np.rint(both / PACK)
                out[:, 2 * j] += both - PACK * high
                out[:, 2 * j + 1] += high
            out -= np.bincount(own, minlength=BUCKETS)[:, None] * random
    out[PAD] = 0
    return out


def vectors_of(sums: np.ndarray, count: np.ndarray) -> np.ndarray:
    """DIM numbers for each bucket: the main directions in which its company differs from the usual."""
    usual = sums.sum(axis=0) / max(np.linalg.norm(sums.sum(axis=0)), 1e-9)
    x = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) - usual * (np.linalg.norm(sums, axis=1, keepdims=True) > 0)
    weight = np.sqrt(count)[:, None]
    _, s, axes = np.linalg.svd(x * weight / max(weight.sum(), 1e-9), full_matrices=False)
    x = x @ axes[:DIM].T
    return (x / max(np.sqrt((x**2 * weight).sum() / max(weight.sum(), 1e-9)), 1e-9)).astype(np.float32)


# --- the attention model

SHAPES = {"E": (BUCKETS, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "O": (DIM, DIM), "far": (SPAN,), "U": (DIM, CLASSES), "c": (CLASSES,)}
LEARNED = [k for k in SHAPES if k != "E"]
N_WEIGHTS = sum(int(np.prod(s)) for s in SHAPES.values())
_DISTANCE = (CONTEXT + np.arange(STRIDE))[:, None] - np.arange(SPAN)[None, :]
_FAR = np.maximum(_DISTANCE, 0)
_CAUSAL = np.where(_DISTANCE < 0, np.float32(-1e4), np.float32(0))


def start_weights(vectors: np.ndarray, seed: int = 7) -> np.ndarray:
    """Embeddings start as the vectors of vectors_of(), and attention as their mean over the context."""
    rng = np.random.default_rng(seed)
    size = {"far": 0, "U": 0, "c": 0}
    start = {k: rng.normal(size=s) * size.get(k, 0.1) for k, s in SHAPES.items()}
    start["E"], start["V"], start["O"] = vectors, start["V"] + np.eye(DIM), start["O"] + np.eye(DIM)
    return np.concatenate([start[k].ravel() for k in SHAPES]).astype(np.float32)


def named(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the flat weights by name."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def windows_of(seqs: list[np.ndarray], bucket: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over sequences of ids: buckets (windows, SPAN) of what goes in, and for the STRIDE places scored the id before, the id and whether it is one."""
    n = np.array([len(s) for s in seqs])
    blocks = -(-n // STRIDE)
    sizes = CONTEXT + blocks * STRIDE
    offset = np.cumsum(sizes) - sizes
    before = np.full(sizes.sum(), -1, dtype=np.int64)
    target = np.full(sizes.sum(), -1, dtype=np.int64)
    for s, o in zip(seqs, offset.tolist()):
        if len(s):
            a = o + CONTEXT
            target[a : a + len(s)] = s
            before[a] = end
            before[a + 1 : a + len(s)] = s[:-1]
    starts = np.repeat(offset, blocks) + STRIDE * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    at = starts[:, None] + np.arange(SPAN)
    buckets = np.where(before >= 0, bucket[before], PAD).astype(np.int32)[at]
    own = at[:, CONTEXT:]
    return buckets, before[own], target[own], target[own] >= 0


class Scorer:
    """The trained model with everything that depends on one subword alone looked up in tables."""

    def __init__(self, weights: np.ndarray, counts: Counts) -> None:
        w = named(weights)
        self.counts = counts
        scale = np.float32(DIM**-0.5)
        self.q, self.k = w["E"] @ w["Q"] * scale, w["E"] @ w["K"]
        # The last column sums the weights; what is not there has none of it.
        self.v = np.concatenate([w["E"] @ w["V"], np.ones((BUCKETS, 1), np.float32)], axis=1)
        self.v[PAD] = 0
        self.out = w["O"] @ w["U"]
        self.base = counts.prior + w["E"] @ w["U"] + w["c"]
        self.bias = np.where(_DISTANCE >= 0, w["far"][np.maximum(_DISTANCE, 0)], 0).astype(np.float32) + _CAUSAL
        long = lambda x: float(np.linalg.norm(x, axis=-1).max())
        #: Whether exponentials stay in range for any input, so that nothing need be cut off.
        self.small = max(long(self.q) * long(self.k) + float(np.abs(w["far"]).max()), long(self.v[:, :DIM]) * long(self.out.T) + float(self.base.max())) < 60

    def logs(self, buckets: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(class of the target) for each place of windows; masked attention in batches."""
        out = np.zeros(target.shape)
        cls = self.counts.cls
        ones = np.ones(self.out.shape[1], np.float32)
        for i in range(0, len(buckets), 64):
            b = buckets[i : i + 64]
            own = b[:, CONTEXT:]
            s = self.q[own] @ self.k[b].transpose(0, 2, 1)
            s += self.bias
            if not self.small:
                np.minimum(s, 30, out=s)
            np.exp(s, out=s)
            a = s @ self.v[b]
            a = a[..., :DIM] / np.maximum(a[..., DIM:], 1e-30)
            x = a.reshape(-1, DIM) @ self.out
            x += self.base.take(own.ravel(), axis=0)
            if not self.small:
                np.minimum(x, 60, out=x)
            picked = x[np.arange(len(x)), cls[np.maximum(target[i : i + 64].ravel(), 0)]].astype(float)
            np.exp(x, out=x)
            out[i : i + 64] = (picked - np.log(x @ ones)).reshape(own.shape)
        return out

    def scores(self, seqs: list[np.ndarray], end: int) -> np.ndarray:
        """log probability of each sequence's classes, in pieces of bounded size."""
        total, at = np.zeros(len(seqs)), 0
        while at < len(seqs):
            to, size = at, 0
            while to < len(seqs) and (to == at or size + len(seqs[to]) < 1 << 16):
                size += len(seqs[to])
                to += 1
            buckets, _, target, real = windows_of(seqs[at:to], self.counts.bucket, end)
            logs = np.concatenate([self.logs(buckets[i : i + 4096], target[i : i + 4096]) for i in range(0, len(buckets), 4096)] or [np.zeros((0, STRIDE))])[real]
            n = np.array([len(s) for s in seqs[at:to]])
            total[at:to] = np.bincount(np.repeat(np.arange(len(n)), n), logs, minlength=len(n))
            at = to
        return total


def gradient(w: dict[str, np.ndarray], prior: np.ndarray, buckets: np.ndarray, at: np.ndarray, cls: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Of the mean -log P(class) over one place `at` of each of a batch of windows, for all weights but the embeddings."""
    scale = np.float32(DIM**-0.5)
    n = len(buckets)
    each, here = np.arange(n), CONTEXT + at
    far = here[:, None] - np.arange(SPAN)
    hidden = (far < 0) | (buckets == PAD)
    far = np.maximum(far, 0)
    x = w["E"][buckets]
    xq, own = x[each, here], buckets[each, here]
    q = xq @ w["Q"] * scale
    qk = q @ w["K"].T
    s = (x @ qk[:, :, None])[:, :, 0] + w["far"][far] + np.where(hidden, np.float32(-1e4), np.float32(0))
    s -= s.max(axis=-1, keepdims=True)
    p = np.exp(s)
    p /= p.sum(axis=-1, keepdims=True)
    px = (p[:, None, :] @ x)[:, 0]
    a = px @ w["V"]
    h = xq + a @ w["O"]
    z = h @ w["U"] + w["c"] + prior[own]
    z -= z.max(axis=-1, keepdims=True)
    y = np.exp(z)
    y /= y.sum(axis=-1, keepdims=True)
    loss = float(-np.log(np.maximum(y[each, cls], 1e-30)).mean())
    y[each, cls] -= 1
    dz = y / np.float32(n)
    g = {"U": h.T @ dz, "c": dz.sum(axis=0)}
    dh = dz @ w["U"].T
    g["O"] = a.T @ dh
    da = dh @ w["O"].T
    g["V"] = px.T @ da
    dpx = da @ w["V"].T
    dp = (x @ dpx[:, :, None])[:, :, 0]
    ds = p * (dp - (dp * p).sum(axis=-1, keepdims=True))
    g["far"] = np.bincount(far.ravel(), ds.ravel(), minlength=SPAN).astype(np.float32)
    dqk = (ds[:, None, :] @ x)[:, 0]
    g["K"], dq = dqk.T @ q, dqk @ w["K"] * scale
    g["Q"] = xq.T @ dq
    return g, loss


def softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of rows (in place) and what they are to be divided by. Rows are lowered by their highest number only where some leave the range."""
    ones = np.ones(x.shape[1], np.float32)
    if x.max() < 60:
        y = np.exp(x)
        total = y @ ones
        if total.min() > 1e-20:
            return y, total
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ ones


def window_gradient(w: dict[str, np.ndarray], prior: np.ndarray, buckets: np.ndarray, cls: np.ndarray, real: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """As gradient(), of all places of windows that hold a subword (real): what a window's places share is found once."""
    scale, n = np.float32(DIM**-0.5), np.float32(real.sum())
    x = w["E"][buckets]
    own, side = buckets[:, CONTEXT:].ravel(), np.ascontiguousarray(x.transpose(0, 2, 1))
    xq = x[:, CONTEXT:].reshape(-1, DIM)
    split, flat = (lambda y: y.reshape(len(x), STRIDE, -1)), (lambda y: y.reshape(-1, DIM))
    q = xq @ w["Q"] * scale
    p = split(q @ w["K"].T) @ side
    p += w["far"][_FAR] + _CAUSAL
    p += np.where(buckets == PAD, np.float32(-1e4), np.float32(0))[:, None, :]
    p, total = softmax(p.reshape(-1, SPAN))
    p /= total[:, None]
    p = split(p)
    px = flat(p @ x)
    a = px @ w["V"]
    h = xq + a @ w["O"]
    y = h @ w["U"]
    y += prior.take(own, axis=0)
    y += w["c"]
    y, total = softmax(y)
    at = np.flatnonzero(real.ravel())
    picked = cls.ravel()[at]
    loss = float(-np.log(np.maximum(y[at, picked] / total[at], 1e-30)).mean())
    y *= (real.ravel() / n / total)[:, None]
    y[at, picked] -= 1 / n
    g = {"U": h.T @ y, "c": y.sum(axis=0)}
    dh = y @ w["U"].T
    g["O"] = a.T @ dh
    da = dh @ w["O"].T
    g["V"] = px.T @ da
    dpx = da @ w["V"].T
    ds = split(dpx) @ side
    ds -= split(np.einsum("ij,ij->i", dpx, px))
    ds *= p
    g["far"] = np.bincount(_FAR.ravel(), ds.sum(axis=0).ravel(), minlength=SPAN).astype(np.float32)
    dqk = flat(ds @ x)
    g["K"], dq = dqk.T @ q, dqk @ w["K"] * scale
    g["Q"] = xq.T @ dq
    return g, loss


class Training:
    """Adam over the windows of one shard's texts, in the order they come."""

    def __init__(self, weights: np.ndarray, counts: Counts, end: int, seed: int, places: int = PLACES) -> None:
        self.places = places
        self.flat = weights.copy()
        self.w, self.counts, self.end = named(self.flat), counts, end
        #: Embeddings stay what the company of subwords in the whole corpus made them; the others learn.
        self.own = self.flat[BUCKETS * DIM :]
        self.m, self.v, self.step, self.seen = np.zeros_like(self.own), np.zeros_like(self.own), 0, 0
        self.random, self.held, self.size = np.random.default_rng(seed), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 1 << 16:
            self.go()

    def go(self) -> None:
        """Every window gives so many of its places that hold a subword, by chance but with STRIDE, where it gives all."""
        if not self.held:
            return
        buckets, _, target, real = windows_of(self.held, self.counts.bucket, self.end)
        self.held, self.size = [], 0
        prior, cls = self.counts.prior, self.counts.cls
        if self.places >= STRIDE:
            order, cls = self.random.permutation(len(buckets)), cls[np.maximum(target, 0)]
            for i in range(0, len(order), BATCH // STRIDE):
                at = order[i : i + BATCH // STRIDE]
                self.move(window_gradient(self.w, prior, buckets[at], cls[at], real[at])[0], int(real[at].sum()))
            return
        row = np.repeat(np.arange(len(buckets)), self.places)
        place = (self.random.random(len(row)) * real.sum(axis=1)[row]).astype(np.int64)
        order = self.random.permutation(len(row))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            r, j = row[at], place[at]
            self.move(gradient(self.w, prior, buckets[r], j, cls[target[r, j]])[0], len(at))

    def move(self, g: dict[str, np.ndarray], places: int) -> None:
        """A step by the gradient of so many places."""
        grad = np.concatenate([g[k].ravel() for k in LEARNED])
        self.step += 1
        self.seen += places
        m, v, step = self.m, self.v, self.step
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        grad *= grad
        v += 0.01 * grad
        self.own -= (RATE / np.sqrt(1 + step / 50) / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def summed(parts: DataFrame, keep: Callable[[DataFrame, str], DataFrame], name: str) -> np.ndarray | None:
    """The sum of arrays x over rows (part, x), by a tree whose tasks take in FAN parts each; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total], pa.list_(pa.float64()))], names=["part", "x"])
        for batch in batches:
            for k, part in enumerate(batch.column(0).to_pylist()):
                x = batch.column(1)[k].values.to_numpy()
                if part // FAN != at:
                    if at is not None:
                        yield row()
                    at, total = part // FAN, np.zeros(len(x))
                total += x
        if at is not None:
            yield row()

    rows, level = keep(parts, f"{name}_0"), 0
    while (most := rows.agg(F.max("part")).first()[0]) is not None and most >= FAN:
        level += 1
        dealt = rows.withColumn("to", F.floor(F.col("part") / FAN).cast("int")).repartitionById(most // FAN + 1, "to").sortWithinPartitions("part").select("part", "x")
        rows = keep(dealt.mapInArrow(run, "part long, x array<double>"), f"{name}_{level}")
    found = [r.x for r in rows.orderBy("part").collect()]
    return np.sum(found, axis=0) if found else None


def gathered(words: DataFrame, n_docs: int, path: str, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[Counts, DataFrame]:
    """Counts of the corpus from its table of words, and the table of pairs (a, b, n)."""
    sub = subwords(path)
    rows = keep(subword_counts(words, path), "subwords")
    single = rows.where("kind < 3").toArrow()
    of = np.zeros((3, sub.end + 1), dtype=np.int64)
    of[single.column("kind").to_numpy(), single.column("a").to_numpy()] = single.column("n").to_numpy()
    return Counts(sub.begins(), of[0], of[1], of[2], n_docs), rows.where("kind = 3").select("a", "b", "n")


def words_inside(words: DataFrame, pairs: DataFrame, counts: Counts, path: str, keep: Callable[[DataFrame, str], DataFrame], most: int = PAIRS) -> DataFrame:
    """word, n, c, inside: the sum of log P(subword | class, the one before) of words."""
    spark = words.sparkSession
    cls, within = counts.cls, counts.within
    if pairs.count() <= most:
        got = pairs.toArrow()
        shared = spark.sparkContext.broadcast(Pairs(np.stack([got.column(c).to_numpy() for c in ("a", "b", "n")], axis=1), cls, within))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sub, known = subwords(path), shared.value
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    part = batch.slice(i, 4096)
                    ids, n = sub.parts(part.column(0).to_pylist())
                    word = np.repeat(np.arange(len(n)), n)
                    inner = np.append(False, word[1:] == word[:-1])[: len(ids)]
                    at = np.flatnonzero(inner)
                    logs = known.within[ids]
                    logs[at] = known.logs(ids[at - 1], ids[at])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.bincount(word, logs, minlength=len(n)))], names=["word", "n", "c", "inside"])

        return words.select("word", "n", "c").mapInArrow(run, "word binary, n long, c long, inside double")
    shared = spark.sparkContext.broadcast((cls, within))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, _ = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls[batch.column(1).to_numpy()])], names=["a", "b", "n", "cls"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, (cls, within) = subwords(path), shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                ids, n = sub.parts(part.column(0).to_pylist())
                word = np.repeat(np.arange(len(n)), n)
                before = np.where(np.append(False, word[1:] == word[:-1])[: len(ids)], np.append(-1, ids[:-1])[: len(ids)], -1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(word)), pa.array(before), pa.array(ids), pa.array(cls[ids]), pa.array(within[ids])], names=["word", "a", "b", "cls", "within"])

    known = keep(pairs.mapInArrow(classed, "a long, b long, n long, cls int"), "pairs")
    per_class = keep(known.groupBy("a", "cls").agg(F.sum("n").alias("n_class")), "pair_classes")
    each = words.select("word").mapInArrow(opened, "word binary, a long, b long, cls int, within double")
    each = each.join(known.select("a", "b", F.col("n").alias("n_pair")), ["a", "b"], "left").join(per_class, ["a", "cls"], "left")
    log = F.when(F.col("a") < 0, F.col("within")).otherwise(F.log((F.coalesce("n_pair", F.lit(0)) + BACK * F.exp("within")) / (F.coalesce("n_class", F.lit(0)) + BACK)))
    return words.select("word", "n", "c").join(each.groupBy("word").agg(F.sum(log).alias("inside")), "word")


def follows(pairs: DataFrame, counts: Counts) -> np.ndarray:
    """How often each class follows each bucket in words (BUCKETS, CLASSES)."""
    shared = pairs.sparkSession.sparkContext.broadcast((counts.bucket, counts.cls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, cls = shared.value
        total = np.zeros(BUCKETS * CLASSES, dtype=np.int64)
        for batch in batches:
            a, b, n = (batch.column(j).to_numpy() for j in range(3))
            np.add.at(total, bucket[a].astype(np.int64) * CLASSES + cls[b], n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = pairs.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS * CLASSES)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(BUCKETS, CLASSES)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def encoded(docs: DataFrame, known, path: str) -> DataFrame:
    """Per row of docs: doc_id, held_out, hash, code (of each word: its place in known, then in the text's own rare words), rare (these words), rare_ids (their subwords), rare_size (how many each has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sub = _Codes(known.value), subwords(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                codes, rares = [], []
                for text in part.column(3).to_pylist():
                    words = words_of(text)
                    code = np.array(list(map(at.__getitem__, words)), dtype=np.int32)
                    rare: dict[bytes, int] = {}
                    for j in np.flatnonzero(code < 0).tolist():
                        code[j] = rare.setdefault(words[j], len(at) + len(rare))
                    codes.append(code)
                    rares.append(list(rare))
                ids, size = sub.parts([w for rare in rares for w in rare])
                words_at = np.cumsum([0, *map(len, rares)])
                ids_at = np.append(0, np.cumsum(size))[words_at]
                lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32()))
                cols = [pa.array(codes, pa.list_(pa.int32())), pa.array(rares, pa.list_(pa.binary())), lists(ids_at, ids), lists(words_at, size)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *cols], names=["doc_id", "held_out", "hash", "code", "rare", "rare_ids", "rare_size"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.xxhash64("doc_id", "text").alias("hash"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, hash long, code array<int>, rare array<binary>, rare_ids array<int>, rare_size array<int>")


def sequences(code: pa.ListArray, rare_ids: pa.ListArray, rare_size: pa.ListArray, known: tuple[np.ndarray, np.ndarray], end: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The ids of documents from encoded() columns, with the end; their words' codes (rare words on from known's, in order of rare) and numbers of words."""
    flat = code.flatten().to_numpy().astype(np.int64)
    n, n_rare = (pc.list_value_length(x).to_numpy().astype(np.int64) for x in (code, rare_size))
    flat += np.where(flat >= len(known[1]), np.repeat(np.cumsum(n_rare) - n_rare, n), 0)
    ids, size = (np.concatenate([x, y.flatten().to_numpy()]) for x, y in zip(known, (rare_ids, rare_size)))
    start, own = np.cumsum(size) - size, size[flat]
    to = np.cumsum(own)
    out = ids[np.repeat(start[flat] - to + own, own) + np.arange(own.sum())]
    cuts = np.append(0, to)[np.cumsum(n)]
    return [np.append(x, end) for x in np.split(out, cuts[:-1])], flat, n


def train(tokens: DataFrame, pairs: DataFrame, counts: Counts, known_ids, keep: Callable[[DataFrame, str], DataFrame], rounds: int = ROUNDS, places: int = PLACES) -> np.ndarray:
    """The weights from encoded() rows; counts get their classes and shares."""
    spark = tokens.sparkSession
    texts = tokens.where("not held_out")
    bucket = spark.sparkContext.broadcast(counts.bucket)

    end = len(counts.begins) - 1

    def seqs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Columns code, rare_ids and rare_size are the last three."""
        of = known_ids.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield sequences(*part.columns[-3:], of, end)[0]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = company(seqs(batches), bucket.value)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sums.ravel()], pa.list_(pa.float64()))], names=["part", "x"])

    sums = summed(texts.select("code", "rare_ids", "rare_size").mapInArrow(meet, "part long, x array<double>"), keep, "company")
    sums = np.zeros((BUCKETS, SKETCH)) if sums is None else sums.reshape(BUCKETS, SKETCH)
    vectors = vectors_of(sums, np.bincount(counts.bucket, counts.count, minlength=BUCKETS))
    counts.classify(vectors)
    counts.follow(follows(pairs, counts))
    weights = start_weights(vectors)
    shared = spark.sparkContext.broadcast(counts)
    shards = max(1, -(-int(counts.count.sum()) // SHARD))
    shard = F.pmod(F.col("hash"), F.lit(shards)).cast("int").alias("shard")
    for turn in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            work, at = None, None
            row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.append(work.flat.astype(float) * work.seen, work.seen)], pa.list_(pa.float64()))], names=["part", "x"])
            for batch in batches:
                own = batch.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(own)) + 1
                for s, e in zip([0, *cuts], [*cuts, len(own)]):
                    if s == e:
                        continue
                    if own[s] != at:
                        if work:
                            work.go()
                            yield row()
                        at, work = int(own[s]), Training(now.value, shared.value, end, int(own[s]) * 31 + turn, places)
                    for some in seqs(iter([batch.slice(s, e - s)])):
                        for ids in some:
                            work.add(ids)
            if work:
                work.go()
                yield row()

        mine = texts.where(F.pmod(F.shiftright("hash", 40), F.lit(rounds)) == turn).select(shard, "hash", "code", "rare_ids", "rare_size")
        dealt = mine.repartitionById(shards, "shard").sortWithinPartitions("shard", "hash").select("shard", "code", "rare_ids", "rare_size")
        total = summed(dealt.mapInArrow(run, "part long, x array<double>"), keep, f"weights_{turn}")
        if total is not None and total[-1]:
            weights = (total[:-1] / total[-1]).astype(np.float32)
    return weights


def lm_scores(docs: DataFrame, path: str, most_pairs: int = PAIRS, places: int = PLACES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    places: how many of the STRIDE places of each training window are predicted.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    with scratch(spark) as keep:
        words = keep(word_counts(docs), "words")
        n_docs, n_train = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum((~held_out()).cast("long")), F.lit(0))).first()
        all_words, in_train, distinct = words.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.sum("c"), F.sum((F.col("c") > 0).cast("long")))]).first()
        train_tokens = in_train + n_train
        below = float(np.log10(train_tokens + 0.1 * (distinct + (n_train > 0) + 1)))
        end_log = float(np.log10(n_train + 0.1)) - below
        least = max(1, int(np.ceil(all_words * SHARE)))
        often = sorted(words.where(F.col("n") >= least).select("word").toArrow().column("word").to_pylist())
        known = spark.sparkContext.broadcast({w: i for i, w in enumerate(often)})
        # Cut to subwords once, and not by every task.
        known_ids = spark.sparkContext.broadcast(subwords(path).parts(often))
        tokens = keep(encoded(docs, known, path), "tokens")
        counts, pairs = gathered(words, n_train, path, keep)
        weights = train(tokens, pairs, counts, known_ids, keep, places=places)
        words = keep(words_inside(words, pairs, counts, path, keep, most_pairs), "words_inside")
        often = words.where(F.col("n") >= least).orderBy("word").toArrow()
        n_train_of, inside_of = often.column("c").to_numpy(), often.column("inside").to_numpy()
        shared = spark.sparkContext.broadcast((n_train_of, inside_of, counts, weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n_train_of, inside_of, counts, weights = shared.value
            model, end = Scorer(weights, counts), len(counts.begins) - 1
            of = known_ids.value
            logs, seen = np.log10(n_train_of + 0.1) - below, n_train_of > 0
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    part = batch.slice(i, 64)
                    seqs, code, n = sequences(part.column(2), part.column(4), part.column(5), of, end)
                    doc = np.repeat(np.arange(len(n)), n)
                    frequent = code < len(logs)
                    of_doc = lambda x: np.bincount(doc[frequent], x[code[frequent]], minlength=len(n))
                    score = (model.scores(seqs, end) + of_doc(inside_of)) / _LN10
                    n_rare = np.bincount(code[~frequent] - len(logs), minlength=len(part.column(3).flatten()))
                    n_rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(pc.list_value_length(part.column(3)).to_numpy())), pa.int32()), pa.array(n_rare, pa.int64()))
                    cols = [pa.array(n + 1), pa.array(int(n_train > 0) + of_doc(seen).astype(np.int64)), pa.array(end_log + of_doc(logs)), pa.array(score), part.column(3), n_rare]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "n_rare"])

        scored = tokens.select("doc_id", "held_out", "code", "rare", "rare_ids", "rare_size").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>, n_rare array<long>")
        scored = keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        # Rare words meet here: a word's rows are under SHARE of all, so none is a hot group.
        rare = scored.select("row", F.explode(F.arrays_zip("rare", "n_rare")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.n_rare").alias("times"))
        rare = rare.join(words.where(F.col("n") < least).select("word", "c", "inside"), "word")
        rare = rare.groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.col("c") + 0.1) - below)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.col("inside") / _LN10).alias("more_score"))
        out = scored.drop("rare", "n_rare").join(rare, "row", "left")
        none = F.lit(0.0)
        return written(out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", none)).alias("base_score"), (F.col("score") + F.coalesce("more_score", none)).alias("score")), "lm_scores")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
