"""Byte-level BPE over a corpus: every different word is encoded once, globally.

Texts are packed into blocks and split into pre-tokens; a pre-token's position is its
place in its block. The distinct words of every block are shuffled by hash, so equal words of all blocks
meet in one task, which encodes each once; a block asks for a word once, however common it is. There are as many
such tasks as shuffle partitions, and more where a task would have to take the words of more than TASK_BYTES of text. Ids
go back to the blocks that asked, joined by block, and are set in by position. Decoding joins ids to the token-byte
table, which has one entry per id of the vocabulary.

Defined results: null and empty texts have no ids and decode to no bytes. Columns of
the input with a name that the operator returns are replaced. Repeated rows get equal results,
a null id is an id like others, empty tables stay empty.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import blocks as B
from evidentia.llm import kernel as K
from evidentia.llm.storage import partitions, prepare, trimmed

_WORDS = "block long, bucket int, payload binary"
TASK_BYTES = 256 << 20


@functools.lru_cache(maxsize=4)
def rank_table(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}


@functools.lru_cache(maxsize=4)
def byte_table(ranks: bytes) -> dict[int, bytes]:
    return {i: token for token, i in rank_table(ranks).items()}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _piece_encoder(ranks: bytes):
    """Ids of one pre-token by the library's merge loop; the pattern is not applied again."""
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=rank_table(ranks), special_tokens={}).encode_ordinary


class TokenBytes:
    """The token-byte table as arrays: the bytes of id i are flat[start[i] : start[i] + size[i]]."""

    def __init__(self, table: dict[int, bytes]):
        self.size = np.full(max(table) + 1, -1, np.int64)
        for i, token in table.items():
            self.size[i] = len(token)
        self.start = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self.flat = np.frombuffer(b"".join(table[i] for i in sorted(table)), np.uint8)

    def joined(self, ids: np.ndarray, upto: np.ndarray) -> list[bytes]:
        """The bytes of the ids from each place in upto to the next."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or (self.size[ids] < 0).any()):
            raise ValueError("an id is not of the vocabulary")
        whole = self.flat[K.ragged(self.start[ids], self.size[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.size[ids])])[upto].tolist()
        return [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]


class _Words:
    """The distinct pre-tokens of a block, dealt over buckets, and every text's positions."""

    def __init__(self, table: pa.Table, text_col: str, buckets: int, spelled: bool):
        hashes, self.parts, seen, held = [], [], 0, []
        for p in K.pretokens(table[text_col]):
            hashes.append(p.hash)
            self.parts.append((p.lo, p.hi, seen + p.first))
            seen += len(p.hash)
            if spelled:
                held.append(p)
        keys = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        at, inverse = K.distinct_at(keys)
        self.position = inverse.astype(np.int32)
        self.n = len(at)
        self.words = []
        before = 0
        for p in held:
            mine = at[np.searchsorted(at, before) : np.searchsorted(at, before + len(p.hash))] - before
            self.words += [p.text[a:b] for a, b in zip(p.start[mine].tolist(), p.end[mine].tolist())]
            before += len(p.hash)
        bucket = (K.mix64(keys[at]) % np.uint64(buckets)).astype(np.int64)
        # Within a bucket in the order of the hashes, which both readings share.
        order = np.lexsort((keys[at], bucket))
        self.buckets = {int(bucket[part[0]]): part for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(part)}


def _ask(text_col: str, buckets: int):
    def run(batches):
        for batch in trimmed(batches):
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = _Words(B.opened(payload.as_buffer()), text_col, buckets, True)
                for bucket, part in w.buckets.items():
                    table = pa.table({"w": pa.array([w.words[i] for i in part.tolist()], pa.string())})
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()),
                            "payload": pa.array([B.packed_table(table)], pa.binary())
                        }
                    )

    return run


def _encode_words(ranks):
    """Encodes each distinct word of a partition once, and answers every block."""

    def run(batches):
        encode = _piece_encoder(ranks.value)
        known: dict[str, list[int]] = {}
        for batch in batches:
            for block, bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = B.opened(payload.as_buffer())["w"].to_pylist()
                ids = []
                for w in words:
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w)
                    ids.append(got)
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
                table = pa.table({"v": pa.array([sizes.tobytes(), flat.tobytes()], pa.binary())})
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()),
                        "payload": pa.array([B.packed_table(table)], pa.binary())
                    }
                )

    return run


def _assemble(text_col: str, buckets: int, ranks, names: list[str], with_ids: bool):
    """Sets each block's ids in by position."""

    def run(batches):
        table_of = TokenBytes(byte_table(ranks.value))
        decimal = [str(i).encode() for i in range(len(table_of.size))]
        for batch in trimmed(batches):
            for block, payload, got in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("answers").to_pylist()):
                table = B.opened(payload.as_buffer())
                w = _Words(table, text_col, buckets, False)
                size, start, flats, base = np.zeros(w.n, np.int64), np.zeros(w.n, np.int64), [], 0
                answers = {a["bucket"]: a["payload"] for a in got or []}
                for bucket, part in w.buckets.items():
                    if bucket not in answers:
                        raise B.unanswered(block)
                    sizes, flat = B.opened(answers[bucket])["v"].to_pylist()
                    sizes, flat = np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(flat, np.uint32)
                    size[part] = sizes
                    start[part] = base + np.cumsum(sizes) - sizes
                    base += len(flat)
                    flats.append(flat)
                flat = np.concatenate(flats).astype(np.int32) if flats else np.zeros(0, np.int32)
                for lo, hi, first in w.parts:
                    word = w.position[first[0] : first[-1]]
                    ids = flat[K.ragged(start[word], size[word])]
                    upto = np.concatenate([[0], np.cumsum(size[word])])[first - first[0]].astype(np.int64)
                    yield from _finished(table.slice(lo, hi - lo), ids, upto, table_of, decimal, names, with_ids)

    return run


def _finished(part: pa.Table, ids: np.ndarray, upto: np.ndarray, table_of: TokenBytes, decimal: list, names: list[str], with_ids: bool):
    spans, each = list(zip(upto[:-1].tolist(), upto[1:].tolist())), ids.tolist()
    one = [hashlib.sha256(b" ".join([decimal[i] for i in each[a:b]])).hexdigest() for a, b in spans]
    two = [hashlib.sha256(x).hexdigest() for x in table_of.joined(ids, upto)]
    part = part.append_column("n_tokens", pa.array(np.diff(upto), pa.int64())).append_column("ids_sha256", pa.array(one, pa.string())).append_column("decoded_sha256", pa.array(two, pa.string()))
    if with_ids:
        part = part.append_column("ids", pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32())))
    yield from part.select(names).combine_chunks().to_batches()


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs without its text, with n_tokens, ids (array of int), ids_sha256 (of the decimal
    ids joined by one space) and decoded_sha256 (of the bytes that the ids decode to).

    ids are those of the rank file at ranks_path, which the driver reads; each match of the
    public byte-level pattern is encoded by itself, and nothing is a special token.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} | (
        {"ids": T.ArrayType(T.IntegerType())} if with_ids else {}
    )
    docs = docs.drop(*[c for c in own if c in docs.columns])
    schema = T.StructType([f for f in docs.schema.fields if f.name != text_col] + [T.StructField(k, v) for k, v in own.items()])
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # a fixed vocabulary
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(partitions(spark), -(-size // TASK_BYTES))
    rows = B.pack(docs, id_col, B.BLOCK_BYTES, n)
    asked = rows.mapInArrow(_ask(text_col, n), _WORDS).repartitionById(n, F.col("bucket"))
    answers = asked.mapInArrow(_encode_words(ranks), _WORDS).groupBy("block").agg(
        F.collect_list(F.struct("bucket", "payload")).alias("answers")
    )
    return rows.join(answers, "block", "left").select("block", "payload", "answers").mapInArrow(
        _assemble(text_col, n, ranks, schema.names, with_ids), schema
    )


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes): the bytes of each row's ids, by their entries in the token-byte table.

    A null list gives no bytes; an id outside the vocabulary raises an error.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        table = TokenBytes(byte_table(ranks.value))
        for batch in batches:
            lists = pc.fill_null(batch.column(1), [])
            ids = np.asarray(lists.flatten()).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table.joined(ids, upto), pa.binary())], names=[id_col, "bytes"])

    schema = T.StructType([encoded.schema[id_col], T.StructField("bytes", T.BinaryType())])
    return encoded.select(id_col, ids_col).mapInArrow(run, schema)
