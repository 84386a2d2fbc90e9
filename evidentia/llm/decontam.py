"""Benchmark decontamination: verbatim benchmark passages in training documents.

Training suffix arrays. Each slice of documents is a shard. The shard's suffixes are
its word positions; those that leave the benchmark's short word
sequences before a window's length can hold no match and are left out. The rest are sorted by
their words up to the window's length, and every test suffix (each window of each
benchmark item, unless the shard lacks its first words) is binary-searched in that array; the range found gives all its
locations, and neighbouring locations on one diagonal (the same place further on in text and
item) make up the longest verbatim matches: one of m words shows as m - width + 1 windows. Nothing is
shuffled: documents are read once where they lie.

A benchmark of at most BLOCK_BYTES of text goes to the executors at once, and a task indexes it once. A larger one
goes block by block, one at a time: a sieve of all its short sequences (a bitmap of at most 2**SIEVE bits)
first finds the documents that can hold any window; only these are written and searched for each block.

Defined results: null and wordless texts have no words, no hits and are clean. Null and
wordless items have no windows. Words in windows of items without id are hit, and such items have matches with a
null item_id; only n_items and items_sha256, which are of ids, leave them out. Items with one id count once. Words compare by 64-bit hashes. Repeated rows get equal results, empty tables stay
empty. Columns of the input with a name that the operator returns are replaced.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import kernel as K
from evidentia.llm.storage import drop, prepare, trimmed, written

WIDTH = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
SIEVE = 30
_BLOOM = 22
_FOUND, _MAYBE = "_found", "_maybe"


def _sequences(texts) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, and where each text's begin."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for w in K.words(texts, K.ALNUM_LOWER):
        hashes.append(w.hash)
        counts.append(np.diff(w.first))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


class TestIndex:
    """The windows of some benchmark items, ready to be searched for."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        self.width, self.ids = width, ids
        self.hashes, first = _sequences(pa.array(texts, pa.string()))
        n = np.diff(first)
        depth = np.minimum(n, width)
        count = np.where(n > 0, n - depth + 1, 0)
        self.vocabulary = np.unique(self.hashes)
        at, item = K.ragged(first[:-1], count), np.repeat(np.arange(len(n)), count)
        depth = depth[item]
        self.least = int(depth.min(initial=width)) if len(at) else 0
        self.gram = min(3, self.least)
        if not len(at):
            return
        key = np.zeros(len(at), np.uint64)
        for d in np.unique(depth).tolist():
            own = depth == d
            key[own] = K.mix64(K.windows(self.hashes, d)[at[own]] + np.uint64(d))
        # Equal windows are searched for once; owners says whose they are.
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        head = np.flatnonzero(new)
        self.at, self.depth = at[order[head]], depth[order[head]]
        self.owner_at = np.append(head, len(order)).astype(np.int64)
        self.owner_item, self.owner_start = item[order], (at - first[item])[order]
        grams = K.windows(self.hashes, self.gram)
        self.begins = grams[self.at]
        self.bloom = np.zeros(1 << _BLOOM, bool)
        self.bloom[grams[K.ragged(first[:-1], np.maximum(n - self.gram + 1, 0))] >> np.uint64(64 - _BLOOM)] = True

    def bounds(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest key of the suffixes that begin with each of these windows."""
        index = np.minimum(self.at[some][:, None] + np.arange(self.width), len(self.hashes) - 1)
        low = self.rank(self.hashes[index.reshape(-1)]).reshape(index.shape)
        beyond = np.arange(self.width) >= self.depth[some][:, None]
        return tuple(
            np.ascontiguousarray(
                np.where(beyond, np.uint32(fill), low).astype(">u4")
            ).view(f"S{4 * self.width}").reshape(-1) for fill in (0, 0xFFFFFFFF)
        )

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """1 + the place in the vocabulary, 0 outside it."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.uint32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)

    def locate(self, w: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, word position) of every occurrence in a shard."""
        none = np.zeros(0, np.int64)
        n = len(w.hash)
        if not self.least or n < self.least:
            return none, none
        grams = K.windows(w.hash, self.gram)
        suffix, room = _candidates(w, self.gram, self.least, self.bloom[grams >> np.uint64(64 - _BLOOM)])
        if not len(suffix):
            return none, none
        here = np.zeros(1 << 18, bool)
        here[grams[suffix] >> np.uint64(64 - 18)] = True
        window = np.flatnonzero(here[self.begins >> np.uint64(64 - 18)])
        steps = np.arange(self.width)
        index = np.minimum(suffix[:, None] + steps, n - 1)
        used = np.unique(index)
        ranks = np.zeros(n, np.uint32)
        ranks[used] = self.rank(w.hash[used])
        key = np.where(steps < room[suffix][:, None], ranks[index], 0).astype(">u4")
        # The suffix array of the shard, down to the window's length.
        flat = np.ascontiguousarray(key).view(f"S{4 * self.width}").reshape(-1)
        order = np.argsort(flat, kind="stable")
        array = flat[order]
        low, high = self.bounds(window)
        lo = np.searchsorted(array, low, side="left")
        hi = np.searchsorted(array, high, side="right")
        count = np.maximum(hi - lo, 0)
        return np.repeat(window, count), suffix[order[K.ragged(lo, count)]]


def _candidates(w: K.Words, gram: int, least: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first `least` words hold only known sequences of `gram` words, and how many words every position has left."""
    n = len(w.hash)
    inside = np.zeros(n, bool)
    inside[: len(known)] = known
    here = np.arange(n)
    text = np.searchsorted(w.first, here, side="right") - 1
    room = w.first[text + 1] - here
    inside &= room >= gram  # sequences do not cross the end of a text
    # How many sequences in a row from each position are the benchmark's?
    out = np.flatnonzero(~inside)
    reach = np.append(out, n)[np.searchsorted(out, here)] - here
    return np.flatnonzero((np.minimum(reach + gram - 1, room) >= least) & inside), room


def _longest(index: TestIndex, window: np.ndarray, place: np.ndarray) -> list[dict]:
    """Maximal matches: runs of occurrences on one diagonal of text and item."""
    count = index.owner_at[window + 1] - index.owner_at[window]
    owner = K.ragged(index.owner_at[window], count)
    item, start = index.owner_item[owner], index.owner_start[owner]
    place, depth = np.repeat(place, count), np.repeat(index.depth[window], count)
    order = np.lexsort((place, place - start, item))
    item, start, place, depth = item[order], start[order], place[order], depth[order]
    new = np.ones(len(order), bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(order)) - 1
    return [
        {
            "item_id": index.ids[int(item[a])], "item_start": int(start[a]), "doc_start": int(place[a]),
            "n_words": int(place[b] - place[a] + depth[b])
        }
        for a, b in zip(head, tail) if len(order)
    ]


_MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("doc_start", T.LongType()),
            T.StructField("n_words", T.LongType())
        ]
    )
)
_OWN = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())
    ]
)


def _search(block, text_col: str, width: int, out_names: list[str], last: bool, with_matches: bool):
    """A pass for one block; `_found` holds hit spans, items and matches so far."""

    def run(batches):
        index = None
        for batch in trimmed(batches):
            if index is None:
                index = TestIndex(*block.value, width)
            table = pa.Table.from_batches([batch])
            n = table.num_rows
            before = table[_FOUND].to_pylist() if _FOUND in table.column_names else [None] * n
            found = [json.loads(x) if x else [[], [], []] for x in before]
            counts = [0] * n
            _apply(index, table[text_col], found, counts, with_matches)
            if last:
                yield from _digest(table, found, counts, out_names, with_matches)
            else:
                if _FOUND in table.column_names:
                    table = table.drop_columns([_FOUND])
                yield from table.append_column(
                    _FOUND, pa.array([json.dumps(f) for f in found])
                ).select(out_names).combine_chunks().to_batches()

    return run


def _shortest(items: DataFrame, width: int) -> int:
    """The length of the shortest window."""

    def run(batches):
        for batch in batches:
            n = np.diff(_sequences(batch.column(0))[1])
            yield pa.RecordBatch.from_pydict({"n": pa.array(n[n > 0], pa.int64())})

    return min(width, items.select("t").mapInArrow(run, "n long").agg(F.min("n")).first()[0] or 0)


def _sieve(items: DataFrame, gram: int, bits: int) -> np.ndarray:
    """A bitmap of the hashes of all sequences of `gram` words of the items."""
    piece = 1 << 20

    def mark(batches):
        out = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            hashes, first = _sequences(batch.column(0))
            at = K.windows(hashes, gram)[K.ragged(first[:-1], np.maximum(np.diff(first) - gram + 1, 0))] >> np.uint64(64 - bits)
            np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        for i in range(0, len(out), piece):
            if out[i : i + piece].any():
                yield pa.RecordBatch.from_pydict(
                    {"i": pa.array([i // piece], pa.int32()), "bits": pa.array([out[i : i + piece].tobytes()], pa.binary())}
                )

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in trimmed(batches):
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0) | np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(list(held), pa.int32()), "bits": pa.array([v.tobytes() for v in held.values()], pa.binary())}
        )

    spread = items.select("t").repartition(8).mapInArrow(mark, "i int, bits binary").repartition(8, "i").mapInArrow(
        merge, "i int, bits binary"
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for i, raw in spread.collect():  # a bitmap of a set size
        out[i * piece : i * piece + len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def _sift(sieve, gram: int, least: int, bits: int, text_col: str, names: list[str]):
    """Adds _maybe, whether a text can hold a window."""

    def run(batches):
        for batch in batches:
            maybe = np.zeros(batch.num_rows, bool)
            for w in K.words(batch.column(text_col), K.ALNUM_LOWER, SHARD_BYTES):
                at = K.windows(w.hash, gram) >> np.uint64(64 - bits)
                known = (sieve.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                some = _candidates(w, gram, least, known.astype(bool))[0]
                maybe[w.lo + np.searchsorted(w.first, some, side="right") - 1] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], names=names)

    return run


def _apply(index: TestIndex, texts, found: list, counts: list[int], with_matches: bool) -> None:
    for w in K.words(texts, K.ALNUM_LOWER, SHARD_BYTES):
        counts[w.lo : w.hi] = np.diff(w.first).tolist()
        window, place = index.locate(w)
        if not len(window):
            continue
        text = np.searchsorted(w.first, place, side="right") - 1
        order = np.argsort(text, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(text[order])) + 1):
            k = int(text[part[0]])
            at, which = place[part] - w.first[k], window[part]
            spans = np.unique(np.stack([at, at + index.depth[which]], axis=1), axis=0)
            different = np.unique(which)
            owners = np.unique(
                index.owner_item[K.ragged(index.owner_at[different], index.owner_at[different + 1] - index.owner_at[different])]
            )
            one = found[w.lo + k]
            one[0] += spans.tolist()
            one[1] += [index.ids[i] for i in owners.tolist()]
            if with_matches:
                one[2] += _longest(index, which, at)


def _digest(table: pa.Table, found: list, counts: list[int], out_names: list[str], with_matches: bool):
    hits, items = [], []
    for (spans, ids, _), n in zip(found, counts):
        edge = np.zeros(n + 1, np.int64)
        if spans:
            s = np.array(spans)
            np.add.at(edge, s[:, 0], 1)
            np.add.at(edge, s[:, 1], -1)
        hits.append(int((np.cumsum(edge) > 0).sum()))
        items.append(sorted(set(ids) - {None}))
    table = table.append_column("n_words", pa.array(counts, pa.int64())).append_column("n_hit", pa.array(hits, pa.int64()))
    table = table.append_column("n_items", pa.array([len(x) for x in items], pa.int64()))
    table = table.append_column("items_sha256", pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]))
    table = table.append_column("contaminated", pa.array([x > 0 for x in hits]))
    if with_matches:
        kind = pa.list_(
            pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
        )
        table = table.append_column("matches", pa.array([f[2] for f in found], kind))
    yield from table.select(out_names).combine_chunks().to_batches()


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH,
    with_text: bool = True, with_matches: bool = False
) -> DataFrame:
    """The rows of docs with n_words, n_hit, n_items, items_sha256, contaminated and,
    if asked for, matches: the longest verbatim matches and their locations.

    A window is `width` consecutive words of an item, or all words of a shorter one;
    a word of a document that any occurrence of a window covers is hit.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = [f.name for f in _OWN.fields] + ["matches", _FOUND, _MAYBE]
    docs = docs.drop(*[c for c in own if c in docs.columns])
    items = benchmark.select(
        F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")
    )
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    final = T.StructType([f for f in docs.schema.fields if with_text or f.name != text_col] + _OWN.fields)
    if with_matches:
        final.add("matches", _MATCH)

    def block(k: int):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).toArrow()  # about BLOCK_BYTES
        return spark.sparkContext.broadcast((part["i"].to_pylist(), part["t"].to_pylist()))

    if n == 1:
        return docs.mapInArrow(_search(block(0), text_col, width, final.names, True, with_matches), final)
    least = _shortest(items, width)
    gram, bits = min(3, least), int(np.clip(np.ceil(np.log2(size * 2)), _BLOOM, SIEVE))
    marked = T.StructType([*docs.schema.fields, T.StructField(_MAYBE, T.BooleanType())])
    sieve = spark.sparkContext.broadcast(_sieve(items, gram, bits) if least else np.zeros(1 << (bits - 3), np.uint8))
    sifted = docs.mapInArrow(_sift(sieve, max(gram, 1), max(least, 1), bits, text_col, marked.names), marked)
    rest = written(sifted.where(_MAYBE).drop(_MAYBE), "candidates")
    for k in range(n):
        last = k == n - 1
        schema = final if last else T.StructType([*docs.schema.fields, T.StructField(_FOUND, T.StringType())])
        held = block(k)
        found = written(rest.mapInArrow(_search(held, text_col, width, schema.names, last, with_matches), schema), "found")
        held.unpersist()
        drop(rest)
        rest = found
    nothing = spark.sparkContext.broadcast(([], []))
    clean = sifted.where(~F.col(_MAYBE)).drop(_MAYBE).mapInArrow(_search(nothing, text_col, width, final.names, True, with_matches), final)
    return rest.union(clean)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without any hit, with the columns they came with."""
    columns = docs.columns
    return contamination(docs, benchmark, **options).where("not contaminated").select(*columns)
