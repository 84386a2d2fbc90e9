"""Token ids of a corpus as a Parquet store that is read selectively.

The store is a folder with two tables. `tokens` holds one row per document in ascending
id order over its files: part, doc_id, local_start, n_tokens and ids, a list
column. ids are dictionary-encoded (a vocabulary fits one dictionary page), row groups and
pages have set sizes, and pages carry column indexes, so a reader of some documents opens
the row groups and pages that hold them, and a reader of n_tokens reads no
ids. `parts` holds the number of ids before each part; a document's place in the
whole stream of ids is that plus its local_start.

Defined results: null and empty texts have only the end id. Rows that share an id stand
next to each other, ordered by the hash of their text; null ids come first. Other columns of the input are not read, whatever
their names; an empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import kernel as K
from evidentia.llm.storage import partitions, prepare, trimmed

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: Words whose ids a worker remembers; beyond this it starts over, ids stay the same.
REMEMBERED = 1 << 20
SLICE_BYTES = 2 << 20
#: A file has about the tokens of so many bytes of text at most: as many files as shuffle partitions, or more.
FILE_BYTES = 512 << 20


class LibraryEncoder:
    """Whole texts to ids with the tokenizers library.

    Where the tokenizer only splits by the public byte-level pattern and merges,
    a pre-token's ids depend on nothing else: the library's model gets each different one
    once. Any other tokenizer gets the whole texts, and so does this one where a text holds the string of
    an added token. Special tokens' strings are text, or with special_as_text false the tokens, as by default in the library.
    """

    def __init__(self, definition: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = special_as_text
        parts = json.loads(definition)
        self.added = [t["content"] for t in parts.get("added_tokens") or () if t["content"] and not (special_as_text and t["special"])]
        split = parts.get("pre_tokenizer") or {}
        self.by_word = not parts.get("normalizer") and not parts.get("post_processor") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.index: dict[int, int] = {}  # by hash
        self.flat, self.size = [], []
        printable = [  # the byte-level alphabet: these as themselves, the rest from 256 on
            *range(33, 127), *range(161, 173), *range(174, 256)
        ]
        rest = iter(range(256, 512))
        self.alphabet = {b: b if b in set(printable) else next(rest) for b in range(256)}

    def _ids(self, word: str) -> list[int]:
        letters = word.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.tokenizer.model.tokenize(letters)]

    def _number(self, key: int, text: str, start: int, end: int) -> int:
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.index)
            ids = self._ids(text[start:end])
            self.flat += ids
            self.size.append(len(ids))
        return at

    def encode(self, column):
        """(lengths, ids) for consecutive slices of the column's texts."""
        if not self.by_word:
            yield from self._whole(column)
            return
        texts = K.as_strings(column)
        holds = np.zeros(len(texts), bool)
        for token in self.added:
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(np.diff(holds, prepend=~holds[:1])).tolist(), len(texts)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield from (self._whole if holds[lo] else self._words)(texts.slice(lo, hi - lo))

    def _whole(self, column):
        for lo in range(0, len(column), 64):
            got = [e.ids for e in self.tokenizer.encode_batch(K.as_strings(column.slice(lo, 64)).to_pylist(), add_special_tokens=False)]
            yield np.array([len(x) for x in got], np.int64), np.fromiter((i for x in got for i in x), np.int32)

    def _words(self, column):
        for p in K.pretokens(column, SLICE_BYTES):
            if len(self.index) > REMEMBERED:
                self.index, self.flat, self.size = {}, [], []
            at, inverse = K.distinct_at(p.hash)
            text, base = p.text, len(self.index)
            local = np.fromiter(
                (self._number(k, text, a, b) for k, a, b in zip(p.hash[at].tolist(), p.start[at].tolist(), p.end[at].tolist())), np.int64,
                len(at)
            )
            self._grow(base)
            word = local[inverse]
            size = self.sizes[word]
            ids = self.values[K.ragged(self.starts[word], size)]
            yield np.diff(np.concatenate([[0], np.cumsum(size)])[p.first]), ids

    def _grow(self, base: int) -> None:
        """Appends the newly numbered words to the arrays."""
        if base == 0:
            self.sizes, self.starts, self.values, self.used, self.filled = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0, 0
        size, flat = np.array(self.size, np.int64), np.array(self.flat, np.int32)
        self.size, self.flat = [], []
        n, m = self.used + len(size), self.filled + len(flat)
        while len(self.sizes) < n:
            self.sizes, self.starts = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.sizes, self.starts))
        while len(self.values) < m:
            self.values = np.concatenate([self.values, np.zeros(len(self.values), np.int32)])
        self.sizes[self.used : n] = size
        self.starts[self.used : n] = self.filled + np.cumsum(size) - size
        self.values[self.filled : m] = flat
        self.used, self.filled = n, m


_encoders: dict[tuple[int, bool], LibraryEncoder] = {}


def _encoder(definition: str, special_as_text: bool) -> LibraryEncoder:
    """One per worker process, which keeps what it remembers from task to task."""
    key = hash(definition), special_as_text
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = LibraryEncoder(definition, special_as_text)
    return _encoders[key]


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    special_as_text: bool = True
) -> None:
    """Encodes docs and writes the store at path; the driver reads the tokenizer's file. See LibraryEncoder for special_as_text."""
    spark = docs.sparkSession
    prepare(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        encoder = _encoder(definition.value, special_as_text)
        for batch in trimmed(batches):
            done = 0
            for size, ids in encoder.encode(batch.column(1)):
                n = len(size)
                ends = np.cumsum(size + 1)
                whole = np.full(int(ends[-1]) if n else 0, end_id, np.int32)
                mine = np.ones(len(whole), bool)
                mine[ends - 1] = False
                whole[mine] = ids
                starts = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(whole))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part), pa.int32()), batch.column(0).slice(done, n).cast(pa.int64()),
                        pa.array(at + starts[:-1], pa.int64()), pa.array(size + 1, pa.int64()), lists
                    ],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"]
                )
                done += n
                at += int(starts[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.repartitionByRange(max(partitions(spark), -(-size // FILE_BYTES)), *order).sortWithinPartitions(*order)
    out = rows.mapInArrow(run, _SCHEMA).write.option("compression", "zstd").option("parquet.enable.dictionary", "true")
    out = out.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option(
        "parquet.page.row.count.limit", PAGE_ROWS
    )
    out.option("parquet.writer.version", "PARQUET_2_0").parquet(f"{path}/tokens")
    sums = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per part
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums.select("part", before.alias("base")).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows as stored; filter by doc_id or select some columns to read only those."""
    return spark.read.schema(_SCHEMA).parquet(f"{path}/tokens")


def placed_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start is the number of ids of all documents before."""
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    rows = read_tokens(spark, path).join(F.broadcast(parts), "part")  # a row per file
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """ids as ids_crc32: the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
            raw = memoryview(values).cast("B")
            ends = lists.offsets.to_numpy().astype(np.int64) * 4
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
