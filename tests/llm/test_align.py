"""Alignment of two tokenizers against the libraries and plain loops over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [c for c in range(256) if c not in printable]
    letter = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(rest)}
    spelled = {i: bytes(letter[c] for c in t) for t, i in a.get_vocab().items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return a, b, spelled, piece


def brute(texts, libraries):
    a, b, spelled, piece = libraries
    found, counts = [], Counter()
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if b"".join(spelled[i] for i in x) != want or b"".join(map(piece, y)) != want:
            x = y = []
        ends = lambda sizes: np.cumsum([0, *sizes]).tolist()
        ea, eb = ends(len(spelled[i]) for i in x), ends(len(piece(i)) for i in y)
        links, j = [], 0
        for i in range(len(x)):
            while eb[j + 1] <= ea[i]:
                j += 1
            k = j
            while k < len(y) and eb[k] < ea[i + 1]:
                links.append((x[i], y[k]))
                k += 1
        both = sorted(set(ea[1:]) & set(eb[1:]))
        groups, lo = [], 0
        for cut in both:
            side = lambda e, ids: ",".join(str(i) for i, p in zip(ids, e[1:]) if lo < p <= cut)  # noqa: E731, B023
            groups.append(side(ea, x) + "|" + side(eb, y))
            lo = cut
        found.append((x, y, groups, links))
        counts.update(links)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (
            len(x), len(y), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        ) for x, y, groups, links in found
    ]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    own = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    odd = [
        None, "", " ", "  ", "   x", "x ", "x  ", "a\tb\n\n c", "▁", "a ▁ b", "<|endoftext|> and <s> </s> <0x0A>", "\x00x\x01", "naïve café ﬁ Ⅷ",
        "👍🏽 🇩🇪 family 👨‍👩‍👧", "日本語のテキスト 漢字", "é̂ ï̈", " leading", "trailing\n", "\n", "a" * 3000, "ab " * 4000, "don't we'll 12345 3.14"
    ]
    word = lambda: r.choice(["the", "of", "é", "  ", "\n", "12", "–", "Ⅷ", "xyz", "zß", "👍"])
    return own + odd + odd[12:16] + ["".join(word() + r.choice(["", " "]) for _ in range(r.randrange(60))) for _ in range(80)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 2000])
def test_against_the_libraries(spark, texts, libraries, monkeypatch, block_bytes):
    monkeypatch.setattr(align, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(align, "REMEMBERED", 500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("id", "block", "pairs", "n_a", "at", "total")}
    ).repartition(5)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t or "" for t in texts], libraries)


def test_runs_give_the_ids_of_whole_texts(texts, libraries):
    full = [t for t in texts if t]
    encoder = align.PieceEncoder(open(B, "rb").read())
    assert encoder.by_run
    raw = [(" " + t).encode() for t in full]
    bounds = np.cumsum([0, *map(len, raw)])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    for by_run in (True, False):
        encoder.by_run = by_run
        n, ids = encoder.encode(buf, bounds)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [libraries[1].encode(t) for t in full]


def test_repeated_rows_null_ids_and_no_rows(spark, libraries):
    rows = [(1, "the cat"), (1, "the cat"), (None, "the cat sat"), (None, None), (2, "▁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(str((r.doc_id, *[r[c] for c in COLUMNS])) for r in align.align(docs, A, B).collect())
    want = brute([t or "" for _, t in rows], libraries)
    assert got == sorted(str((i, *w)) for (i, _), w in zip(rows, want))
    assert align.align(docs.limit(0), A, B).count() == 0
    assert align.align(docs.where("text IS NULL"), A, B).collect()[0][1:] == (0, 0, 0, 0, "", 0, 0)


def test_a_place_closes_one_link():
    at, kind = align.cuts(np.array([2, 5, 9]), np.array([1, 5, 6, 9]), 9)
    assert at.tolist() == [1, 2, 5, 6, 9] and kind.tolist() == [2, 1, 3, 2, 3]
