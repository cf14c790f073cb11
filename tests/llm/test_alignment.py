import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kelpline.llm import alignment as A

PATHS = (public_tokenizers.path(A.BYTE_BPE), public_tokenizers.path(A.PIECES))
DOCS = "doc_id long, text string"


def tokens():
    """Encoders of a text to (id, bytes), by the libraries alone."""
    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def a(text):
        return [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]

    def b(text):
        return [(i, bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()) for i in p.encode(text)]

    return a, b


def brute(texts):
    a_of, b_of = tokens()
    docs, counts = [], {}
    for text in texts:
        want = (" " + text).encode() if text else b""
        a, b = (a_of(text), b_of(text)) if text else ([], [])
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            docs.append(([], [], [], []))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = [tuple([x[2] for x in side if (ends[k - 1] if k else 0) < x[1] <= e] for side in spans) for k, e in enumerate(ends)]
        docs.append((a, b, groups, links))
        for p in set(links):
            counts[p] = counts.get(p, 0) + 1
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for a, b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out, counts, most


def texts():
    rng = random.Random(3)
    words = ["the", "alignment", "tokenizers", "été", "naïve", "日本語", "co-operate", "3.14159", "don't", "🙂", "<|endoftext|>", "</s>", "x" * 50, "Übermaß", "▁", "<0x41>"]
    some = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(60)]
    return [*some, *some[:5] * 4, None, "", " ", "  two  spaces ", "tab\tand\nline", "é", "ﬁligature", "end ", "\x00\x01", "a", "　wide"]


@pytest.mark.parametrize("block", [40, 500, 1 << 20])
def test_alignment_equals_brute_force(spark, block):
    all_texts = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(all_texts)], f"{DOCS}, other string").withColumnRenamed("other", "TEXT").repartition(3)
    aligned, pairs = A.alignments(docs, *PATHS, block)
    got = {r.doc_id: tuple(r)[1:] for r in aligned.collect()}
    want, counts, most = brute(all_texts)
    assert got == dict(enumerate(want))
    assert sum(w[0] > 0 for w in want) > 30 and any(t and not w[0] for t, w in zip(all_texts, want))
    assert {(r.a, r.b): (r.n_docs, r.best) for r in pairs.collect()} == {p: (n, n == most[p[0]]) for p, n in counts.items()}


def test_alignment_of_a_long_text_in_parts(spark):
    rng = random.Random(8)
    text = " ".join(rng.choice(["alpha", "beta", "gamma's", "1,000", "ünï", "x"]) for _ in range(20_000))
    rows = [(1, text), (None, text), (1, text + "!"), (2, "y" * 5000)]
    whole = sorted(map(str, A.alignments(spark.createDataFrame(rows, DOCS), *PATHS)[0].collect()))
    parts = sorted(map(str, A.alignments(spark.createDataFrame(rows, DOCS), *PATHS, 3000)[0].collect()))
    assert whole == parts and len(A.units(text, True, 3000)) > 20


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([(None, None), (1, "")], DOCS)
    assert sorted(tuple(r)[1:] for r in A.alignments(docs, *PATHS)[0].collect()) == [(0,) * 6 + ("",)] * 2
    assert A.alignments(docs.limit(0), *PATHS)[0].count() == 0
