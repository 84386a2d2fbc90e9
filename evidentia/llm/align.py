"""Two tokenizers' tokens of the same texts, aligned by bytes, and how a pair of ids occurs linked over the corpus.

A is a byte-level tokenizer that gets a blank and the text, B a piece tokenizer that puts that blank itself, so both
spell the same bytes. The texts of a batch are laid out one after the other; where tokens of A and of B end is counted
once over all their bytes. Every place where any token ends closes one link, that of the A and the B
token before it; places where both end cut the texts into groups; sums up to each document's last byte, less those up to
the one before, are its results.

How often a pair is linked needs the whole corpus. Documents go into blocks: a block keeps its documents' results and, for
each document, its different pairs as numbers into the block's different pairs. Only a block's different pairs are
shuffled: once to be counted, with sums before the shuffle, and once to bring the block its counts, joined by pair
and then by block. The highest count of each id of B is a table with an entry per id of its vocabulary.

Defined results: null and empty texts, and those whose joined tokens of A or of B are other bytes than blank and text
(as with U+2581, which B takes for a blank), have no tokens: zeros, and '' for groups_sha256. Repeated rows count
as often as they occur. Null ids are ids like others. Only id and text are read, so no other column's name matters; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import blocks as B
from evidentia.llm import kernel as K
from evidentia.llm.bpe import TokenBytes
from evidentia.llm.storage import drop, prepare, trimmed, written
from evidentia.llm.tokenstore import LibraryEncoder

BLOCK_BYTES = 8 << 20
#: Different runs of blanks with what follows whose ids a worker remembers; beyond this it starts over, ids stay the same.
REMEMBERED = 1 << 18
OWN = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCKS = "block long, docs binary, pairs array<struct<pair:long,n:long>>"
_MARK = "▁"


class PieceEncoder:
    """Ids of texts by the sentencepiece library, and the bytes of its pieces.

    Where no piece has a blank behind another character, as in BPE over words, merges never pass from a word into the
    blanks behind it: a run of blanks with what follows has the same ids wherever it stands, and the library gets each
    different one once. Any other model gets whole texts.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {
            i: bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)
        }
        self.blank = sp.piece_to_id(_MARK)
        plain = "".join(self.bytes[i].decode() for i in sp.encode("  a  b ")) == "   a  b "  # nothing is normalised away
        self.by_run = plain and not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.known: dict[int, bytes] = {}

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def encode(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, ids) of texts in UTF-8, each with the blank before it; text k is buf[bounds[k] : bounds[k + 1]]."""
        if not self.by_run:
            raw = buf.tobytes()
            got = self.whole([raw[a + 1 : b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
            return np.array([len(x) for x in got], np.int64), np.fromiter((i for x in got for i in x), np.int32)
        blank = buf == 32
        head = blank.copy()
        head[1:] &= ~blank[:-1]
        head[bounds[:-1]] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(buf))
        hashes = K.span_hashes(_Bytes(buf), start, end)
        at, inverse = K.distinct_at(hashes)
        if len(self.known) > REMEMBERED:
            self.known = {}
        keys = hashes[at].tolist()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        raw = buf.tobytes()
        runs = [raw[start[at[k]] + 1 : end[at[k]]].decode() for k in new]
        for k, run, ids in zip(new, runs, self.whole(runs)):
            self.known[keys[k]] = np.array(ids if run else [self.blank], np.int32).tobytes()
        ids = [self.known[key] for key in keys]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat, first = np.frombuffer(b"".join(ids), np.int32), np.cumsum(size) - size
        each = size[inverse]
        text = np.searchsorted(bounds, start, side="right") - 1
        return np.bincount(text, weights=each, minlength=len(bounds) - 1).astype(np.int64), flat[K.ragged(first[inverse], each)]


class _Bytes:
    def __init__(self, buf: np.ndarray):
        self.buf = buf

    def __getitem__(self, part: slice) -> np.ndarray:
        return (self.buf[part].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


class Aligned(NamedTuple):
    """Per document n_a, n_b, n_groups, n_links and the digest of its groups; of every link its document and its ids of A and B."""

    results: dict[str, np.ndarray]
    digests: list[str]
    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray


def cuts(a_end: np.ndarray, b_end: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(places where a token ends, in order; 1 where one of A does, 2 of B, 3 of both)."""
    ends = np.bincount(a_end, minlength=total + 1) + 2 * np.bincount(b_end, minlength=total + 1)
    at = np.flatnonzero(ends)
    return at, ends[at]


def _up_to(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between each place in bounds and the next."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


class Aligner:
    """One of A's and B's encoders and tables in a worker."""

    def __init__(self, definition: str, model: bytes):
        self.a_encoder = LibraryEncoder(definition, special_as_text=True)
        letter = {chr(c): b for b, c in self.a_encoder.alphabet.items()}
        vocabulary = self.a_encoder.tokenizer.get_vocab()
        self.a_bytes = TokenBytes({i: bytes(letter[c] for c in t) for t, i in vocabulary.items() if all(c in letter for c in t)})
        self.b_encoder = PieceEncoder(model)
        self.b_bytes = TokenBytes(self.b_encoder.bytes)
        # What a token is in the groups' text: its id and a comma, or at its side's end in the group the mark of that side.
        spelled = lambda n, mark: [x for i in range(n) for x in (b"%d," % i, b"%d%s" % (i, mark))]
        self.n_a = len(self.a_bytes.size)
        self.spelled = spelled(self.n_a, b"|") + spelled(len(self.b_bytes.size), b";")

    def _sides(self, texts: pa.Array):
        """Per side (ids of each text, ids, their sizes) of texts with the blank before them; none where its bytes are not the text's."""
        for _, _, buf, bounds in K.slices(texts, max(texts.nbytes, 1)):
            sizes, ids = zip(*self.a_encoder.encode(texts))
            sides = [(np.concatenate(sizes), np.concatenate(ids)), self.b_encoder.encode(buf, bounds)]
            good = np.ones(len(texts), bool)
            for table, (n, ids) in zip((self.a_bytes, self.b_bytes), sides):
                good &= spells(table, n, ids, buf, bounds)
            for table, (n, ids) in zip((self.a_bytes, self.b_bytes), sides):
                ids = ids[np.repeat(good, n)].astype(np.int64)
                yield np.where(good, n, 0), ids, table.size[ids]

    def align(self, texts: pa.Array) -> Aligned:
        """texts are not empty, and begin with the blank put before them."""
        (n_a, a, a_size), (n_b, b, b_size) = self._sides(texts)
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        total = int(a_end[-1]) if len(a) else 0
        at, kind = cuts(a_end, b_end, total)
        a_first, b_first = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        last = np.concatenate([[0], a_end])[a_first]  # each document's last byte
        bounds = np.searchsorted(at, last, side="right")
        of_a, of_b, both = kind & 1, kind >> 1, kind == 3
        links = np.diff(bounds)
        results = {"n_a": n_a, "n_b": n_b, "n_groups": _up_to(both, bounds), "n_links": links}
        digests = self._digests(a, b, of_a, of_b, both, a_first + b_first)
        return Aligned(
            results, digests, np.repeat(np.arange(len(texts)), links), a[np.cumsum(of_a) - of_a], b[np.cumsum(of_b) - of_b]
        )

    def _digests(self, a, b, of_a, of_b, both, first) -> list[str]:
        """Of each document's groups as text: A's ids, B's ids, group by group."""
        group = np.cumsum(both) - both
        closes_a, closes_b = (np.flatnonzero(x) for x in (of_a, of_b))
        group_a, group_b, n = group[closes_a], group[closes_b], int(both.sum())
        through_a = np.cumsum(np.bincount(group_a, minlength=n))
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n))])
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + before_b[group_a]] = 2 * a + both[closes_a]
        code[np.arange(len(b)) + through_a[group_b]] = 2 * (self.n_a + b) + both[closes_b]
        spelled, code, first, out = self.spelled, code.tolist(), first.tolist(), []
        for x, y in zip(first[:-1], first[1:]):
            text = b"".join([spelled[c] for c in code[x:y]])
            out.append(hashlib.sha256(text[:-1]).hexdigest() if y > x else "")
        return out


def spells(table: TokenBytes, n: np.ndarray, ids: np.ndarray, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether the ids of each text, n of them, join to its bytes."""
    size = table.size[ids]
    first = np.concatenate([[0], np.cumsum(n)])
    good = _up_to(size, first) == np.diff(bounds)
    mine, text = np.repeat(good, n), np.repeat(good, np.diff(bounds))
    joined = table.flat[K.ragged(table.start[ids[mine]], size[mine])]
    same = joined == buf[text]
    if not same.all():
        wrong = np.repeat(np.arange(len(n)), np.diff(bounds))[text][~same]
        good[np.unique(wrong)] = False
    return good


class _Block:
    """Documents' results, and their different pairs as numbers into the block's."""

    def __init__(self):
        self.rows, self.digests, self.keys, self.n, self.per_doc, self.bytes = [], [], [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array, aligner: Aligner) -> None:
        full = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        results, digests = {c: np.zeros(len(texts), np.int64) for c in OWN}, np.full(len(texts), "", object)
        per_doc = np.zeros(len(texts), np.int64)
        if len(full):
            got = aligner.align(pc.binary_join_element_wise("", texts.take(pa.array(full)), " "))
            for c in OWN:
                results[c][full] = got.results[c]
            digests[full] = got.digests
            key = (got.b << 32 | got.a).astype(np.uint64)
            at, pair = K.distinct_at(K.mix64(key))
            each, n = np.unique(full[got.doc] * len(at) + pair, return_counts=True)
            per_doc = np.bincount(each // max(len(at), 1), minlength=len(texts))
            self.keys.append(key[at].astype(np.int64))
            self.n.append((each % max(len(at), 1), n))
        else:
            self.keys.append(np.zeros(0, np.int64))
            self.n.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
        self.rows.append(
            pa.table({"id": ids, **{c: pa.array(results[c]) for c in OWN}, "groups_sha256": pa.array(digests, pa.string()), "pairs": pa.array(per_doc)})
        )
        self.bytes += texts.nbytes

    def packed(self) -> pa.RecordBatch:
        keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        firsts = np.cumsum([0, *map(len, self.keys)])
        at = np.concatenate([inverse[f + local] for f, (local, _) in zip(firsts, self.n)])
        n = np.concatenate([n for _, n in self.n])
        docs = pa.concat_tables(self.rows)
        payload = B.packed_table(pa.table({
            "docs": [B.packed_table(docs)], "at": [at.astype(np.int32).tobytes()], "n": [n.astype(np.int32).tobytes()]
        }))
        number = int.from_bytes(hashlib.blake2b(payload, digest_size=8).digest(), "little", signed=True)
        sums = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.int64())], ["pair", "n"])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([payload], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pairs)],
            names=["block", "docs", "pairs"]
        )


_aligners: dict[int, Aligner] = {}


def _aligner(definition: str, model: bytes) -> Aligner:
    """One per worker process, which keeps what its encoders remember from task to task."""
    key = hash((definition, model))
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(definition, model)
    return _aligners[key]


def _aligned_blocks(definition, model, most: int):
    def run(batches):
        aligner, block = _aligner(definition.value, model.value), _Block()
        for batch in trimmed(batches):
            texts = K.as_strings(batch.column(1))
            for lo, hi, _, _ in K.slices(texts):
                block.add(batch.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo), aligner)
                if block.bytes >= most:
                    yield block.packed()
                    block = _Block()
        if block.rows:
            yield block.packed()

    return run


def _finished(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with their sums over its pairs' counts."""
    at = counts["at"].to_numpy()
    size = int(at.max()) + 1 if len(at) else 0
    total, best = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    total[at], best[at] = counts["total"].to_numpy(), counts["best"].to_numpy()
    out = []
    for block, raw in zip(docs["own"].to_pylist(), docs["docs"]):
        held = B.opened(raw.as_buffer())
        rows = B.opened(held["docs"][0].as_buffer())
        at, n = (np.frombuffer(held[c][0].as_buffer(), np.int32).astype(np.int64) for c in ("at", "n"))
        if len(at) and (at.max() >= size or (total[at] < 0).any()):
            raise B.unanswered(block)
        bounds = np.concatenate([[0], np.cumsum(rows["pairs"].to_numpy())])
        n_best, count_sum = _up_to(n * best[at], bounds), _up_to(n * total[at], bounds)
        out.append(
            rows.drop_columns("pairs").append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))
        )
    return pa.concat_tables(out)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row.

    a_path is a tokenizers file (A), b_path a sentencepiece model (B); the driver reads both. See the contract above for the columns:
    n_best counts links whose pair is as common as any of its id of B, count_sum adds up the links' counts over the corpus.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        definition, model = spark.sparkContext.broadcast(f.read()), spark.sparkContext.broadcast(g.read())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(rows.mapInArrow(_aligned_blocks(definition, model, BLOCK_BYTES), _BLOCKS), "aligned")
    pairs = blocks.select("block", F.posexplode("pairs").alias("at", "p")).select("block", "at", "p.*")
    sums = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    sums = written(sums.withColumn("b", F.shiftright("pair", 32).cast("int")), "pair-counts")
    highest = sums.groupBy("b").agg(F.max("total").alias("highest"))  # a row per id of B's vocabulary
    counts = sums.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    answers = pairs.select("block", "at", "pair").join(counts, "pair").select("block", "at", "total", "best")
    kinds = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType()}
    kinds |= {"n_best": T.LongType(), "count_sum": T.LongType()}
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(k, v) for k, v in kinds.items()]])
    found = blocks.select(F.col("block").alias("own"), "docs").groupBy("own").cogroup(answers.groupBy("block")).applyInArrow(_finished, schema)
    return found.withColumnRenamed("id", id_col)
