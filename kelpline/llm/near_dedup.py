"""Near duplicates by ProbMinHash, banding and verification.

A text is the multiset of its five-word shingles. Every shingle is a Poisson process whose rate
is its count; an arrival has a time and a register, and each register holds the shingle that
arrives there first. Arrivals are drawn until none can come before the latest register's time.
Registers agree with the probability Jaccard similarity. Texts that agree in a band of registers
meet in a bucket and are verified: similar are those whose probability Jaccard similarity of
whole shingle multisets is 0.8 or more.

In a bucket, the text with most company is compared with all others. Where that leaves a bucket
in several classes, all its texts of different classes are, in blocks of texts: those whose
sketches (one bit for each of SKETCH further registers) differ by no more than a pair at the
threshold does, with four standard deviations to spare, are verified in the first bucket they
share. Blocks of one class aren't compared with each other. No bucket is cut short, and copies of
one text count once.

Defined results: texts with equal words, as those without any, are in one class; of fewer than
five words the whole text is one shingle; a null text is empty; a class's id is its smallest
doc_id (null if all are), of which one row is kept; an empty table gives an empty table; other
columns are dropped.

Joins are all sort-merge: the rounds' many small tables would each leave a broadcast on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, pick, scratch, settled, table
from .shingles import PLACES, mix, windows, word_hashes

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
#: Bits of a sketch, and texts in a block.
SKETCH, BLOCK = 2048, 128
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(windows(words, WORDS), return_counts=True)


def signature(shingles: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """For each register the shingle that is the first to arrive there."""
    times = np.full(registers, np.inf)
    out = np.zeros(registers, dtype=np.uint64)
    live, rate, last, drawn = shingles, counts.astype(float), np.zeros(len(shingles)), 0
    while len(live):
        n = max(1, registers // len(live))
        number = np.arange(drawn + 1, drawn + n + 1, dtype=np.uint64) * GOLDEN
        bits = mix(live[:, None] + number[None, :])
        gaps = -np.log(((bits >> np.uint64(24)).astype(float) + 0.5) * 2.0**-40) / rate[:, None]
        at = last[:, None] + np.cumsum(gaps, axis=1)
        register = (bits & np.uint64(0xFFFFFF)).astype(np.int64) % registers
        flat, reg = at.ravel(), register.ravel()
        np.minimum.at(times, reg, flat)
        first = flat == times[reg]
        out[reg[first]] = np.repeat(live, n)[first]
        last, drawn = at[:, -1], drawn + n
        go_on = last < times.max()
        live, rate, last = live[go_on], rate[go_on], last[go_on]
    return out


def bands_of(registers: np.ndarray) -> np.ndarray:
    rows = registers.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        h = h + rows[:, j] * PLACES[j]
    return mix(h).view(np.int64)


def sketch(shingles: np.ndarray, counts: np.ndarray) -> bytes:
    """A bit of the shingle in each of SKETCH registers: two texts of similarity s differ in a share (1 - s) / 2 of them."""
    if not len(shingles):
        return bytes(SKETCH // 8)
    held = signature(shingles, counts, SKETCH) + np.arange(SKETCH, dtype=np.uint64) * GOLDEN
    return np.packbits((mix(held) & np.uint64(1)).astype(np.uint8)).tobytes()


def may_differ(similar: float) -> float:
    """Bits in which sketches of texts that are just similar differ at most, but for one pair in 30,000."""
    share = (1 - similar) / 2
    return SKETCH * share + 4 * (SKETCH * share * (1 - share)) ** 0.5


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets: over common i, the sum of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio)
    ratio, x, y = ratio[order], x[order], y[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    below, above = np.append(0, np.cumsum(y))[upto], x.sum() - np.append(0, np.cumsum(x))[upto]
    both = (x > 0) & (y > 0)
    return float((1 / (above[both] / x[both] + below[both] / y[both])).sum())


def _node(words: np.ndarray) -> bytes:
    """Equal for texts with equal words."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_hash, node (binary), bands (array of long, none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                words = word_hashes([x or b"" for x in part.column(2).to_pylist()])
                bands = [bands_of(signature(*weighted(w))) if len(w) else np.zeros(0, np.int64) for w in words]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(_node, words), pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles, counts, sketch of the texts whose rows wanted names (doc_id, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                words = word_hashes([x or b"" for x in batch.column(0).slice(i, 256).to_pylist()])
                sets = [weighted(w) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array(map(_node, words), pa.binary()), pa.array([s.view(np.int64) for s, _ in sets], pa.list_(pa.int64())), pa.array([c.astype(np.int32) for _, c in sets], pa.list_(pa.int32())), pa.array([sketch(*x) for x in sets], pa.binary())], names=["node", "shingles", "counts", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    named = wanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(named, same, "left_semi").select(F.col("text").cast("binary")).mapInArrow(run, "node binary, shingles array<long>, counts array<int>, sketch binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Of pairs (a, b: nodes), those whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                s = [part.column(j) for j in range(2, 6)]
                value = lambda c, k: np.asarray(c[k].values)
                good = [similarity((value(s[0], k).view(np.uint64), value(s[1], k)), (value(s[2], k).view(np.uint64), value(s[3], k))) >= similar - 1e-12 for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"), F.col("counts").alias(f"c{x}")).hint("merge")
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "ca", "sb", "cb")
    return both.mapInArrow(run, "a binary, b binary")


def blocks(members: DataFrame) -> DataFrame:
    """band, own, id, texts (a list of about BLOCK of the structs `text`) of members (band, node, comp, text).

    own: the class of all texts of the block where that class fills one; else null.
    """
    n = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.when(F.col("n") >= BLOCK, F.col("comp")))
    rest = n.where("own is null").groupBy("band").agg(F.sum("n").alias("n"))
    n = n.where("own is not null").select("band", "comp", "own", "n")
    dealt = members.join(n.hint("merge"), ["band", "comp"], "left").join(rest.withColumnRenamed("n", "n_rest").hint("merge"), "band", "left")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("n", "n_rest") / BLOCK))
    dealt = dealt.withColumn("id", F.xxhash64("own", part))
    return dealt.groupBy("band", "own", "id").agg(F.collect_list("text").alias("texts"))


def alike(blocked: DataFrame, similar: float = SIMILAR, sketches: bool = True) -> DataFrame:
    """Pairs (a, b: nodes) of blocks' texts that are of different classes, whose sketches allow for a link, each in the first of the buckets that both are in.

    Without sketches all such pairs are. Blocks are paired by their ids; a block's texts then go to each pair, wherever it is.
    """
    most = may_differ(similar) if sketches else SKETCH

    def opened(texts: pa.ListScalar) -> tuple[list, list, np.ndarray, list]:
        node, comp, bits, bands = (texts.values.field(i) for i in range(4))
        return node.to_pylist(), comp.to_pylist(), np.frombuffer(b"".join(bits.to_pylist()), dtype=np.uint64).reshape(len(bits), -1), bands.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for band, one, other in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                node, comp, bits, bands = opened(one)
                node_b, comp_b, bits_b, bands_b = opened(other) if other.is_valid else (node, comp, bits, bands)
                near = np.bitwise_count(bits[:, None, :] ^ bits_b[None, :, :]).sum(axis=2, dtype=np.int32) <= most
                if not other.is_valid:
                    near = np.triu(near, 1)
                for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                    if comp[i] != comp_b[j] and min(set(bands[i]) & set(bands_b[j])) == band:
                        out.append((min(node[i], node_b[j]), max(node[i], node_b[j])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    ids = lambda k: blocked.select("band", F.col("own").alias(f"own_{k}"), F.col("id").alias(f"id_{k}"))
    met = ids("x").join(ids("y").hint("merge"), "band").where("id_x <= id_y and (own_x is null or own_y is null or own_x <> own_y)").select("band", "id_x", "id_y")
    texts = lambda k: blocked.select("band", F.col("id").alias(f"id_{k}"), F.col("texts").alias(k)).hint("merge")
    both = met.join(texts("x"), ["band", "id_x"]).join(texts("y"), ["band", "id_y"])
    return both.select("band", "x", F.when(F.col("id_x") < F.col("id_y"), F.col("y")).alias("y")).mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, comp for all nodes of links (a, b); comp is the smallest node that links lead to.

    start: such a table of some of the links, from which the rest goes on.

    Each round joins every class to its smallest neighbour; ids are hashes, so classes at least
    halve in expectation.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    comps = nodes.withColumn("comp", F.col("node"))
    if start is not None:
        comps = nodes.join(start.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    comps = settled(comps)
    open_links = links
    while True:
        named = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")).hint("merge")
        cross = settled(open_links.join(named("a"), "a").join(named("b"), "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct())
        if cross.isEmpty():
            return comps
        hook = cross.groupBy(F.col("a").alias("comp")).agg(F.min("b").alias("to"))
        comps = settled(comps.join(hook.hint("merge"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        open_links = cross


def near_classes(docs: DataFrame, similar: float = SIMILAR, sketches: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, class_id, class_size, n_verified, kept, text_hash.

    n_verified counts the links of the row's text with other texts that were verified, which join
    the class but aren't all of its similar pairs. Without sketches no pair that meets in a
    bucket of several classes is left out.
    """
    with scratch(docs.sparkSession) as keep:
        return _classes(pick(docs, "doc_id", "text"), similar, sketches, keep)


def _classes(docs: DataFrame, similar: float, sketches: bool, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    rows = keep(signatures(docs), "signatures")
    # One row stands for the texts with its words.
    one = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "bands")).alias("r"))
    spread = one.select("node", F.explode("r.bands").alias("band"))
    sizes = spread.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = keep(spread.join(sizes.hint("merge"), "band"), "buckets")
    company = keep(met.groupBy("node").agg(F.sum("size").alias("company"), F.collect_list("band").alias("bands")), "company")
    wanted = one.join(company.hint("merge"), "node", "left_semi").select("r.doc_id", "r.text_hash")
    sets = keep(shingle_sets(docs, wanted), "shingles")

    hub = keep(met.join(company.select("node", "company").hint("merge"), "node").groupBy("band").agg(F.max(F.struct("company", "node")).alias("hub")), "hubs")
    pairs = met.join(hub.hint("merge"), "band").where("node <> hub.node").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    links = settled(verified(pairs, sets, similar))
    comps = components(links)
    left = met.select("band", "node").join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = left.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    left = left.join(mixed.select("band").hint("merge"), "band", "left_semi")
    text = F.struct("node", "comp", "sketch", "bands").alias("text")
    left = left.join(sets.select("node", "sketch").hint("merge"), "node").join(company.select("node", "bands").hint("merge"), "node").select("band", "node", "comp", text)
    more = settled(verified(keep(alike(keep(blocks(keep(left, "mixed")), "blocks"), similar, sketches), "alike"), sets, similar))
    if not more.isEmpty():
        links = settled(links.union(more))
        comps = components(links, comps)

    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_verified"))
    marked = rows.select("doc_id", "text_hash", "node").withColumn("row", F.monotonically_increasing_id())
    marked = marked.join(comps.join(degree.hint("merge"), "node", "left").hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    marked = settled(marked.select("doc_id", "text_hash", "comp", "row", F.coalesce("n_verified", F.lit(0)).alias("n_verified")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row"))
    # Kept apart, so that a class of very many rows is split in the join.
    classes = settled(marked.groupBy("comp").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size")))
    return marked.join(classes.hint("merge"), "comp").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_verified", (F.col("row") == F.col("first.row")).alias("kept"), "text_hash")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).drop("text_hash")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pick(docs, "doc_id", "text", "lang", "source", "n_chars")
    return keep_rows(docs, near_classes(docs))
