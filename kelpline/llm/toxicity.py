"""Toxicity behind a noisy channel.

A character language model (four-grams of letter classes, counted over all texts) decodes what
may be disguised: leetspeak, letters set apart by spaces or signs, and repeated letters span a
lattice of readings, and Viterbi's algorithm takes the likeliest. Words and word beginnings of
the restored text are its features. The FEATURES of them whose share of toxic labelled texts has
the highest lower confidence bound are weighed by a logistic regression, whose probability is the
score.

Labels are learned from a sample of about LABELLED rows at most, spread by hash; the language
model and the scores cover every row and whole texts.

Defined results: null and empty texts, and those with no telling word, score alike and low; labels that are null are left out, and of rows with one id the toxic one counts;
rows that repeat are each scored; without toxic and other labels every score is 0.1; empty tables give empty
results; other columns are dropped.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from os.path import commonprefix
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, scratch, table

LABELLED = 20_000
#: Of their features, those that speak for toxic the most are weighed.
FEATURES = 4000
THRESHOLD = 0.7
K = 28  # classes: 0 other, 1 to 26 letters, 27 beyond ASCII
#: What may stand for a letter.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SIGNS = set("._-*~'")
#: Log10 probabilities of the channel: a letter written as a sign, a sign put between letters, a letter repeated.
SWAPPED, PARTED, REPEATED = -0.7, -0.7, -0.2
PREFIXES = range(3, 8)
#: Of so many characters at most, so that any prefix holds it.
STEM = min(PREFIXES)
#: Tokens whose features are remembered: so many, of so many characters at most.
REMEMBERED, LONG = 300_000, 64
Z = 2.5
L2 = 5e-5
_CLASS = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b > 127 else 0 for b in range(256)], dtype=np.int32)
_LETTER, _SIGN, _STANDS, _TWICE = (re.compile(x) for x in (r"[a-z]", r"[0-9@$!|+._*~-]", r"[0-9@$!|+]", r"([a-z])\1"))
_SPACED = re.compile(r"(?<!\S)[a-z0-9@$!|+](?:\s+[a-z0-9@$!|+]){2,}(?!\S)")
_JOINS = re.compile(r"[\s._*~-]+")
#: Signs at a word's end, which may stand for letters too.
_FINAL = "!$|+@"
#: After so many characters, what all readings have in common is settled.
SETTLED = 256
_EDGES = "\"#%&'()*,-./:;<=>?[\\]^_`{}~"


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Of all texts; at most K ** 4 numbers, however many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**4, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                data = b" ".join(x or b"" for x in batch.column(0).slice(i, 64).to_pylist())
                for a in range(0, len(data), 1 << 20):
                    c = _CLASS[np.frombuffer(data[max(0, a - 3) : a + (1 << 20)], dtype=np.uint8)]
                    if len(c) > 3:
                        total += np.bincount(((c[:-3] * K + c[1:-2]) * K + c[2:-1]) * K + c[3:], minlength=K**4)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(K**4)
    for gram, n in rows:
        out[gram] = n
    return out.reshape(K, K, K, K)


def language_model(counts: np.ndarray, prior: float = 5.0) -> np.ndarray:
    """log10 P(d | a, b, c); each order leans on the one below it with the weight of prior counts."""
    p = np.full(K, 1 / K)
    for order in range(1, 5):
        c = counts.sum(axis=tuple(range(4 - order)))
        p = (c + prior * p) / (c.sum(axis=-1, keepdims=True) + prior)
    return np.log10(p).astype(np.float32).ravel()


def disguised(token: str) -> bool:
    """Whether a token may be more than it shows: a letter before a sign, what may stand for a letter before one, or a letter twice. Each is one look from left to right."""
    follows = lambda first, then: (at := first.search(token)) is not None and then.search(token, at.end()) is not None
    return follows(_LETTER, _SIGN) or follows(_STANDS, _LETTER) or _TWICE.search(token) is not None


class Decoder:
    def __init__(self, model: np.ndarray) -> None:
        #: As Python looks up one number at a time.
        self.model = array("d", model.astype(float).tobytes())
        self.known: dict[str, list[str]] = {}
        self.old: dict[str, list[str]] = {}

    def letters(self, raw: str) -> str:
        """span() of a stretch of letters alone: each has one reading, so only repeats leave a choice."""
        model, kk = self.model, K**3
        states: dict[tuple[int, str], tuple[float, str]] = {(0, ""): (0.0, "")}
        for char in raw:
            code = ord(char)
            own = code - 96 if 97 <= code <= 122 else 27 if code > 127 else 0
            after: dict[tuple[int, str], tuple[float, str]] = {}
            for (context, last), (score, text) in states.items():
                context = context * K + own
                key, new = (context % kk, char), score + model[context]
                if key not in after or new > after[key][0]:
                    after[key] = (new, text + char)
                if char == last:
                    key, new = (context // K, last), score + REPEATED
                    if key not in after or new > after[key][0]:
                        after[key] = (new, text)
            states = after
        ends = ((score + (model[context * K] if context % K else 0.0), text) for (context, _), (score, text) in states.items())
        return max(ends)[1]

    def span(self, raw: str) -> str:
        """The likeliest reading of a stretch in lower case, of any length. A state is the last three classes and the last character."""
        model, kk, done = self.model, K**3, []
        states: dict[tuple[int, str], tuple[float, str]] = {(0, ""): (0.0, "")}
        for i, char in enumerate(raw):
            if i % SETTLED == SETTLED - 1:
                same = commonprefix([text for _, text in states.values()])
                done.append(same)
                states = {k: (score, text[len(same) :]) for k, (score, text) in states.items()}
            code = ord(char)
            own = code - 96 if 97 <= code <= 122 else 27 if code > 127 else 0
            ways = [(own, char, 0.0)] + [(ord(x) - 96, x, SWAPPED) for x in LEET.get(char, "")]
            after: dict[tuple[int, str], tuple[float, str]] = {}
            for (context, last), (score, text) in states.items():
                for cls, out, cost in ways:
                    if not cls and not context % K:  # a run of other characters is one boundary
                        new = score
                    else:
                        new = score + cost + model[context * K + cls]
                    key = ((context * K + cls) % kk, out)
                    if key not in after or new > after[key][0]:
                        after[key] = (new, text + out)
                    if cls and out == last:
                        key = (context, last)
                        if key not in after or score + REPEATED + cost > after[key][0]:
                            after[key] = (score + REPEATED + cost, text)
                if (char in SIGNS or char == " ") and context % K:
                    key = (context, last)
                    if key not in after or score + PARTED > after[key][0]:
                        after[key] = (score + PARTED, text)
            states = after
        ends = ((score + (model[context * K] if context % K else 0.0), text) for (context, _), (score, text) in states.items())
        return "".join([*done, max(ends)[1]])

    def word(self, token: str) -> str:
        """A token between white space, in lower case, without the signs around it and restored."""
        bare = token.strip(_EDGES).rstrip(_FINAL)
        return self.span(bare) if len(bare) > 2 and disguised(bare) else bare

    def readings(self, token: str) -> list[str]:
        """The words of word(), where signs may join several, and what they are if the signs at its end are letters."""
        whole = token.strip(_EDGES)
        if whole.isalpha() and len(whole) < SETTLED:
            return [self.letters(whole) if len(whole) > 2 and _TWICE.search(whole) else whole]
        out = [self.word(token)]
        if len(whole) > 2 and whole[-1] in _FINAL and any("a" <= c <= "z" for c in whole):
            out.append(self.span(whole).rstrip(_FINAL))
        return list(dict.fromkeys(x for r in out for x in _JOINS.split(r) if x))

    def remembered(self, token: str) -> list[str]:
        """As readings(); those of late and of before are kept."""
        if (out := self.known.get(token)) is None:
            if len(token) > LONG:
                return self.readings(token)
            if len(self.known) >= REMEMBERED:
                self.known, self.old = {}, self.known
            out = self.known[token] = self.old.get(token) or self.readings(token)
        return out

    def restore(self, text: str) -> str:
        lower = _SPACED.sub(lambda m: self.span(" ".join(m[0].split())), text.lower())
        return re.sub(r"\S+", lambda m: self.word(m[0]), lower)


def word_features(word: str) -> list[str]:
    return [f"={word}", *[f"{word[:k]}*" for k in PREFIXES if len(word) >= k]]


def stems_of(features: Iterable[str]) -> set[str]:
    """How words with one of the features begin; no other word has any of them."""
    return {f[1 : 1 + STEM] if f[:1] == "=" else f[:STEM] for f in features} | {f[:STEM] for f in features}


def tokens_of(decoder: Decoder, text: str | None) -> set[str]:
    return set(_SPACED.sub(lambda m: decoder.span(" ".join(m[0].split())), (text or "").lower()).split())


def regression(rows: list[tuple[list[int], int]], n: int) -> tuple[np.ndarray, float]:
    """Logistic regression over sets of features, by gradients with momentum; weights and the constant."""
    y = np.array([label for _, label in rows], dtype=float)
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feature = np.array([x for f, _ in rows for x in f], dtype=np.int64)
    often = np.sqrt(np.bincount(feature, minlength=n) + 1.0)
    w, v, base, vb = np.zeros(n), np.zeros(n), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 0.0
    for _ in range(500):
        off = 1 / (1 + np.exp(-(base + np.bincount(doc, w[feature], minlength=len(rows))))) - y
        v = 0.9 * v - 0.3 * (np.bincount(feature, off[doc], minlength=n) / often + L2 * len(rows) * w / often)
        vb = 0.9 * vb - 0.3 * off.mean()
        w, base = w + v / 4, base + vb
    return w, float(base)


def learned(docs: DataFrame, labels: DataFrame, grams: np.ndarray, limit: int = LABELLED) -> tuple[dict[str, float], float]:
    """Features with their weights, and the constant. Of rows with one id, one text is learned from."""
    with scratch(docs.sparkSession) as keep:
        return _learned(docs, labels, grams, limit, keep)


def _learned(docs: DataFrame, labels: DataFrame, grams: np.ndarray, limit: int, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[dict[str, float], float]:
    spark = docs.sparkSession
    known = pick(labels, "doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    known = keep(known, "known")
    share = min(1.0, limit / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About limit rows at most, so they are broadcast.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    model = spark.sparkContext.broadcast(grams)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                words = [list({x for t in tokens_of(decoder, text) for x in decoder.remembered(t)}) for text in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), part.column(1).cast(pa.int32())], names=["words", "toxic"])

    rows = keep(rows.select("text", "toxic").mapInArrow(restored, "words array<string>, toxic int"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for words, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    count = (toxic if label else clean).update
                    count([""])
                    count(["=" + x for x in words])
                    for k in PREFIXES:
                        count({x[:k] + "*" for x in words if len(x) >= k})
        both = list({**toxic, **clean})
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([toxic[x] for x in both], pa.int64()), pa.array([toxic[x] + clean[x] for x in both], pa.int64())], names=["feature", "toxic", "n"])

    sums = rows.mapInArrow(count, "feature string, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    p, z2 = F.col("toxic") / F.col("n"), Z * Z
    low = (p + z2 / (2 * F.col("n")) - Z * F.sqrt(p * (1 - p) / F.col("n") + z2 / (4 * F.col("n") ** 2))) / (1 + z2 / F.col("n"))
    best = sums.where("feature = '' or toxic >= 5").select("feature", "toxic", "n", low.alias("low")).orderBy((F.col("feature") == "").desc(), F.desc("low"), "feature").limit(FEATURES + 1).collect()
    toxic, n = next(((r.toxic, r.n) for r in best if not r.feature), (0, 0))
    if not 0 < toxic < n:
        return {}, math.log(1 / 9)
    telling = {f: i for i, f in enumerate(r.feature for r in best if r.feature and r.low > toxic / n)}
    index = spark.sparkContext.broadcast(telling)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        stems = stems_of(at)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [sorted({at[f] for x in words if x[:STEM] in stems for f in word_features(x) if f in at}) for words in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32())), part.column(1)], names=["found", "toxic"])

    weights, base = regression([(r[0], r[1]) for r in rows.mapInArrow(found, "found array<int>, toxic int").collect()], len(telling))
    return {f: float(weights[i]) for f, i in telling.items()}, base


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, score."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    grams = language_model(gram_counts(docs))
    weights, base = learned(docs, labels, grams)
    model = spark.sparkContext.broadcast((grams, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, weights = model.value
        decoder, known, old, stems = Decoder(grams), {}, {}, stems_of(weights)

        def telling(token: str) -> tuple[str, ...]:
            return tuple(f for x in decoder.readings(token) if x[:STEM] in stems for f in word_features(x) if f in weights)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for text in part.column(1).to_pylist():
                    tokens = tokens_of(decoder, text)
                    if len(known) > REMEMBERED:
                        known, old = {}, known
                    found = set()
                    for t in tokens:
                        if (own := known.get(t)) is None:
                            own = old[t] if t in old else telling(t)
                            if len(t) <= LONG:
                                known[t] = own
                        if own:
                            found.update(own)
                    x = base + sum(weights[f] for f in sorted(found))
                    out.append(1 / (1 + math.exp(-max(-500, min(500, x)))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def restored(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, restored (in lower case, white space kept; a null stays null)."""
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = docs.sparkSession.sparkContext.broadcast(language_model(gram_counts(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t and decoder.restore(t) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "restored"])

    return docs.mapInArrow(run, "doc_id long, restored string")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
