"""Removal of long word sequences that occur earlier, by prefix-partitioned suffix trees.

Every suffix (a word position with at least `width` words left) belongs to the group of a
variable-length prefix, so that all suffixes that agree in `width` words are of one group. A prefix
first reaches to the smallest, by hash, of the `gram`-word sequences in the suffix's first `width` words (of that
sequence only its words count, so neighbouring suffixes mostly share it and travel as one run
of words). Where such a group is larger than a group may be, its prefixes grow: to all words up to the
end of that sequence, and then to all `width` words. Which groups are that large is
counted on a sample of the documents, as sizes decide nothing but where a suffix goes.

A suffix that shares its `width` words with no other can lie below no node of that depth. So suffixes first meet in
their groups as prints (32 bits of a hash of these words, besides the group's), and only those that find
an equal one come back with their words. A task takes its groups in order, as many at a time as GROUP_BYTES hold, and sorts the suffixes
by their words. The common prefixes of neighbours give the subtrees: every
internal node of depth `width` is a repeat, its smallest leaf the first occurrence, and
unions of the other leaves that stand next to each other are the maximal repeated spans. Should one group still be larger
than GROUP_BYTES (one window in very many blocks), it is reduced as it comes: a leaf with an earlier
one on its path is answered and let go.

Leaves that repeat within a block of documents are settled there, so a passage
that fills the corpus reaches its group once per block. Answers are the late
leaves, by block; texts are moved once, compressed. Words compare by 64-bit hashes.

Defined results: null and empty texts have no words. A repeated row (same id and
text) is no earlier than its twin: both keep what either keeps. Rows are ordered
by (id, start); a null id comes first. Words are never cut; order is kept. Columns
of the input with a name that the operator returns are replaced; empty tables stay empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import blocks as B
from evidentia.llm import kernel as K
from evidentia.llm.storage import partitions, prepare, release_memory

#: A block's windows take about 30 times as many bytes while they are sorted.
BLOCK_BYTES = 4 << 20
GROUP_BYTES = 8 << 20
#: As many tasks as shuffle partitions, and more where one would have to take the suffixes of more text.
TASK_BYTES = 256 << 20
WIDTH = 20
GRAM = 5
#: About how many bytes a suffix takes with its neighbours, and on its own.
_IN_RUN, _ALONE = 20, 130
#: One in so many documents is counted, and fewer where that were more than SAMPLE_BYTES of them.
SAMPLED, SAMPLE_BYTES = 64, 1 << 30
_PRINTS = "label long, block long, place int, prints binary"
_RUNS = "label long, block long, place int, n int, doc long, start long, text binary"
_ANSWERS = "block long, late binary"


class _Block:
    """The words of a block and the windows that are not settled inside it."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, width: int, gram: int, spelled: bool = False):
        self.table, self.width, self.gram = table, width, gram
        self.texts = K.as_strings(table[text_col])
        ids = table[id_col].combine_chunks().cast(pa.int64())
        self.ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        hashes, counts, sizes, spelling = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for w in K.words(self.texts, K.BLANK_EXACT):
            hashes.append(w.hash)
            counts.append(np.diff(w.first))
            if spelled:
                size = w.end - w.start + 1
                chars = np.append(w.buf, np.uint8(32))[K.ragged(w.start, size)]
                chars[np.cumsum(size) - 1] = 32
                sizes.append(size)
                spelling.append(chars.tobytes())
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.spelling, self.at_byte = b"".join(spelling), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self._suffixes()

    def _suffixes(self) -> None:
        width, gram = self.width, self.gram
        room = np.maximum(self.counts - width + 1, 0)
        self.at = K.ragged(self.first[:-1], room)  # flat positions of all windows
        row = np.repeat(np.arange(len(room)), room)
        self.doc, self.start = self.ids[row], (self.at - self.first[row]).astype(np.int64)
        if not len(self.at):
            self.window = self.smallest = np.zeros(0, np.uint64)
            self.settled, self.open, self.twin_of = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        self.window = K.windows(self.hashes, width)[self.at]
        self.grams = ends = K.windows(self.hashes, gram)
        reach, least = 1, ends  # least: the smallest of `reach` sequences from here on
        want = width - gram + 1
        while reach < want:
            step = min(reach, want - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        self.smallest = least[self.at]
        # The same window earlier in this block?
        self.twin_of = K.first_of(self.window)
        self.settled = self.twin_of != np.arange(len(self.window))
        if (self.ids[1:] == self.ids[:-1]).any():  # flat order is not that of (id, start)
            order = np.lexsort((self.start, self.doc, self.window))
            new = np.ones(len(order), bool)
            new[1:] = self.window[order][1:] != self.window[order][:-1]
            head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
            self.twin_of[order] = head
            self.settled = (self.doc != self.doc[self.twin_of]) | (self.start != self.start[self.twin_of])
        self.open = np.flatnonzero(~self.settled & (self.twin_of == np.arange(len(self.window))))  # a repeated row's window is its twin's

    def up_to_smallest(self, some: np.ndarray) -> np.ndarray:
        """Hashes of all words from these suffixes' beginnings to the end of their smallest sequence."""
        out = np.zeros(len(some), np.uint64)
        at = self.at[some]
        depth = np.zeros(len(some), np.int64)
        for k in range(self.width - self.gram, -1, -1):
            depth[self.grams[at + k] == self.smallest[some]] = k + self.gram
        for n in np.unique(depth).tolist():
            own = depth == n
            out[own] = K.windows(self.hashes, n)[at[own]]
        return out

    def labels(self, large: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The group of every open suffix; large holds the groups of each level that are too large."""
        out = self.smallest[self.open].copy()
        grown = np.flatnonzero(_among(out, large[0]))
        if len(grown):
            longer = self.up_to_smallest(self.open[grown])
            whole = _among(longer, large[1])
            out[grown] = K.mix64(longer + np.uint64(1))
            out[grown[whole]] = K.mix64(self.window[self.open[grown[whole]]] + np.uint64(2))
        return out

    def _cut(self, label: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of neighbours of one group begin among some of the open suffixes, and how long they are."""
        at = self.at[self.open[some]]
        broken = np.ones(len(some), bool)
        broken[1:] = (label[1:] != label[:-1]) | (at[1:] != at[:-1] + 1) | (self.start[self.open[some]][1:] == 0)
        run = np.flatnonzero(broken)
        return run, np.diff(np.append(run, len(some)))

    def prints(self, block: int, large: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        """The open suffixes as prints, in runs; a row without any says that the block was asked about."""
        label = self.labels(large)
        run, n = self._cut(label, np.arange(len(self.open)))
        ends = np.concatenate([[0], np.cumsum(n), [n.sum()]]) * 4
        flat = self.window[self.open].astype(np.uint32)
        prints = pa.Array.from_buffers(pa.binary(), len(run) + 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(label[run].view(np.int64), block)), pa.array(np.full(len(run) + 1, block)),
                pa.array(np.append(run, 0), pa.int32()), prints
            ],
            names=["label", "block", "place", "prints"]
        )

    def runs(self, block: int, large: tuple[np.ndarray, np.ndarray], shared: list[bytes]) -> pa.RecordBatch:
        """The open suffixes that share their print, as runs of words; a row without words says that the block was asked about."""
        some = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in shared)])).astype(np.int64)
        label = self.labels(large)[some]
        run, n = self._cut(label, some)
        first = self.open[some[run]]
        lo, hi = self.at_byte[self.at[first]], self.at_byte[self.at[first] + n + self.width - 1] - 1
        texts = [self.spelling[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        ack = lambda v, kind: pa.array(np.append(v, 0), kind)
        columns = [
            np.append(label[run].view(np.int64), block), np.full(len(run) + 1, block), ack(some[run], pa.int32()), ack(n, pa.int32()),
            ack(self.doc[first], pa.int64()), ack(self.start[first], pa.int64()), pa.array([*texts, b""], pa.binary())
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["label", "block", "place", "n", "doc", "start", "text"])

    def covered(self, answers: list[bytes]) -> np.ndarray:
        """For every word whether a window that occurs earlier covers it."""
        out = np.zeros(len(self.at), bool)
        for answer in answers:
            out[self.open[np.frombuffer(answer, np.uint32)]] = True
        if len(self.at):
            out = self.settled | out[self.twin_of]
        edge = np.zeros(int(self.first[-1]) + 1, np.int64)
        hits = self.at[out]
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + self.width, -1)
        return np.cumsum(edge)[:-1] > 0


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _joint(words: np.ndarray, bits: int) -> list[np.ndarray]:
    """Columns of several words each, in order; sorting by them is sorting by the words."""
    each = 64 // bits
    out = []
    for at in range(0, words.shape[1], each):
        key = np.zeros(len(words), np.uint64)
        for column in words[:, at : at + each].T:
            key = key << np.uint64(bits) | column.astype(np.uint64)
        out.append(key)
    return out


class Subtree:
    """The deep part of the suffix trees of some runs of words (doc, start, n, text): the leaves that share
    their first `width` words with others, sorted by these words, and the depth to which neighbours agree."""

    def __init__(self, runs: pa.Table, width: int):
        n = runs["n"].to_numpy().astype(np.int64)
        doc, start = runs["doc"].to_numpy(), runs["start"].to_numpy()
        hashes, windows, at, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for w in K.words(runs["text"].cast(pa.string()), K.BLANK_EXACT):
            place = K.ragged(w.first[:-1].astype(np.int64), n[w.lo : w.hi])
            windows.append(K.windows(w.hash, width)[place])
            hashes.append(w.hash)
            at.append(place + seen)
            seen += len(w.hash)
        hashes, window, at = np.concatenate(hashes), np.concatenate(windows), np.concatenate(at)
        run = np.repeat(np.arange(len(n)), n)
        offset = K.ragged(np.zeros(len(n), np.int64), n)
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        shared = np.zeros(len(order), bool)
        shared[1:] |= same
        shared[:-1] |= same
        leaf = order[shared]
        self.doc, self.start = doc[run[leaf]], start[run[leaf]] + offset[leaf]
        spelt, rank = K.distinct_at(hashes)  # words as numbers; any order of words will do for sorting
        words = rank.astype(np.uint32)[at[leaf][:, None] + np.arange(width)]
        sort = np.lexsort((self.start, self.doc, *_joint(words, max(len(spelt) - 1, 1).bit_length())[::-1]))
        words = words[sort]
        self.run, self.offset, self.doc, self.start = run[leaf][sort], offset[leaf][sort], self.doc[sort], self.start[sort]
        agree = words[1:] == words[:-1]
        self.common = np.where(agree.all(axis=1), width, agree.argmin(axis=1)) if len(words) > 1 else np.zeros(0, np.int64)
        self.width = width

    def late(self) -> np.ndarray:
        """Which leaves have an earlier one below the same internal node of depth `width`."""
        new = np.append(np.ones(min(1, len(self.doc)), bool), self.common < self.width)
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        return (self.doc != self.doc[head]) | (self.start != self.start[head])


def _places(block: np.ndarray, place: np.ndarray, asked: list[int]) -> pa.RecordBatch:
    """Places of suffixes, one row a block, and an empty row for each block that was asked about."""
    order = np.argsort(block, kind="stable")
    parts = [p for p in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(p)]
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([int(block[p[0]]) for p in parts] + asked, pa.int64()),
            "late": pa.array([place[p].astype(np.uint32).tobytes() for p in parts] + [b""] * len(asked), pa.binary())
        }
    )


def _in_groups(settle):
    """Settles the groups of a partition that is sorted by label, whole groups of GROUP_BYTES together. settle
    gives what it found, and a function for what is left of a group that goes on."""

    def run(batches):
        held, size, most = [], 0, GROUP_BYTES
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(0).to_numpy()
            if size >= GROUP_BYTES and held:
                # What goes on in this batch: the last group, if it is one.
                table = pa.Table.from_batches(held).combine_chunks()
                own = table["label"].to_numpy() == label[0]
                if not own.all():
                    yield settle(table.filter(pa.array(~own)))[0]
                    held = table.filter(pa.array(own)).to_batches()
                    most = GROUP_BYTES
                elif size >= most:
                    found, rest = settle(table)
                    yield found
                    left = rest()
                    held = left.to_batches()
                    most = max(GROUP_BYTES, 2 * left.nbytes)  # different windows stay
                size = sum(b.nbytes for b in held)
                release_memory()
            held.append(batch)
            size += batch.nbytes
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks())[0]
            release_memory()

    return run


def _sharing(runs: pa.Table):
    """Suffixes whose print another of their group has."""
    prints = runs["prints"].combine_chunks()
    ends = np.frombuffer(prints.buffers()[1], np.int32)[prints.offset : prints.offset + len(prints) + 1].astype(np.int64) // 4
    flat = np.frombuffer(prints.buffers()[2], np.uint32)[ends[0] : ends[-1]]
    n = np.diff(ends)
    run = np.repeat(np.arange(len(n)), n)
    place = runs["place"].to_numpy()[run] + K.ragged(np.zeros(len(n), np.int64), n)
    label, block = runs["label"].to_numpy(), runs["block"].to_numpy()
    key = label[run].view(np.uint64) ^ K.mix64(flat.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    alone = first.copy()
    alone[:-1] &= first[1:]
    shared, kept = order[~alone], order[first]

    def left() -> pa.Table:
        prints = pa.Array.from_buffers(
            pa.binary(), len(kept),
            [None, pa.py_buffer(np.arange(len(kept) + 1, dtype=np.int32) * 4), pa.py_buffer(np.ascontiguousarray(flat[kept]))]
        )
        return pa.table(
            {"label": label[run[kept]], "block": block[run[kept]], "place": pa.array(place[kept], pa.int32()), "prints": prints}
        )

    return _places(block[run[shared]], place[shared], block[n == 0].tolist()), left


def _late(width: int):
    """Leaves that have an earlier one on their path."""

    def settle(runs: pa.Table):
        tree = Subtree(runs, width)
        late = np.flatnonzero(tree.late())
        run, n, block = tree.run[late], runs["n"].to_numpy(), runs["block"].to_numpy()
        found = _places(block[run], runs["place"].to_numpy()[run] + tree.offset[late], block[n == 0].tolist())
        gone = np.bincount(run, minlength=runs.num_rows)
        return found, lambda: runs.filter(pa.array(gone < np.maximum(n, 1)))

    return settle


def _large(docs: DataFrame, size: int, tasks: int, id_col: str, text_col: str, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups whose suffixes are more than a task should hold at once, by level; there are at most
    as many as the corpus has times GROUP_BYTES, and none in a small one."""
    total = size * 4  # bytes of runs, about
    most = min(GROUP_BYTES, max(total // (8 * tasks), 1 << 15))  # a small part of a task, too
    none = np.zeros(0, np.uint64)
    if total <= most:
        return none, none
    one_in = int(np.clip(total // SAMPLE_BYTES, SAMPLED, 4096))
    some = docs.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(one_in)) == 0).select(id_col, text_col)

    def count(batches):
        for table in B.packed(batches, BLOCK_BYTES):
            block = _Block(table, id_col, text_col, width, gram)
            for level, labels in enumerate((block.smallest[block.open], block.up_to_smallest(block.open) if len(block.open) else none)):
                label, n = np.unique(labels, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(label), level), pa.int32()), pa.array(label.view(np.int64)), pa.array(n, pa.int64())],
                    names=["level", "label", "n"]
                )

    sums = some.mapInArrow(count, "level int, label long, n long").groupBy("level", "label").agg(F.sum("n").alias("n"))
    size = F.col("n") * one_in * F.when(F.col("level") == 0, _IN_RUN).otherwise(_ALONE)
    found = sums.where(size > most).select("level", "label").collect()
    return tuple(np.sort(np.array([r["label"] for r in found if r["level"] == level], np.int64).view(np.uint64)) for level in (0, 1))


def _joined(w: K.Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    start, size = w.start[keep], w.end[keep] - w.start[keep] + 1
    chars = np.append(w.buf, np.uint8(32))[K.ragged(start, size)]
    last = np.cumsum(size)
    chars[last - 1] = 32
    upto = np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(keep)])[w.first]]
    whole = chars.tobytes()
    return [whole[a : b - 1] if b > a else b"" for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, with_text: bool = True,
    with_spans: bool = False
) -> DataFrame:
    """The rows of docs with each word removed that a repeated window covers.

    A window is `width` consecutive words; it is repeated if its words also start
    earlier (smaller id, or earlier in the same text). A text that loses words
    becomes its kept words joined by one space, others stay as they are. Adds
    n_words, n_removed, kept_sha256 (of the kept words joined by one space) and,
    if asked for, repeats: the maximal removed spans as (first word, past last).
    """
    spark = docs.sparkSession
    prepare(spark)
    own = ["n_words", "n_removed", "kept_sha256", "repeats"]
    docs = docs.drop(*[c for c in own if c in docs.columns])
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    tasks = max(partitions(spark), -(-size // TASK_BYTES))
    large = spark.sparkContext.broadcast(_large(docs, size, tasks, id_col, text_col, width, gram))
    rows = B.pack(docs, id_col, BLOCK_BYTES, tasks)

    def ask(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _Block(B.opened(payload.as_buffer()), id_col, text_col, width, gram).prints(block, large.value)
                release_memory()

    def spell(batches):
        for batch in batches:
            for block, payload, shared in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("late").to_pylist()):
                if shared is None:
                    raise B.unanswered(block)
                yield _Block(B.opened(payload.as_buffer()), id_col, text_col, width, gram, spelled=True).runs(block, large.value, shared)
                release_memory()

    def answered(asked: DataFrame, settle) -> DataFrame:
        grouped = asked.repartition(tasks, "label").sortWithinPartitions("label").mapInArrow(_in_groups(settle), _ANSWERS)
        return rows.join(
            grouped.groupBy("block").agg(F.collect_list("late").alias("late")), "block", "left"
        ).select("block", "payload", "late")

    sharing = answered(rows.mapInArrow(ask, _PRINTS), _sharing)
    answers = answered(sharing.mapInArrow(spell, _RUNS), _late(width))
    out_schema = T.StructType(
        [f for f in docs.schema.fields if with_text or f.name != text_col] + [
            T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())
        ]
    )
    if with_spans:
        out_schema.add("repeats", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())])))

    def clean(batches):
        for batch in batches:
            for block, payload, late in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("late").to_pylist()):
                if late is None:
                    raise B.unanswered(block)
                tree = _Block(B.opened(payload.as_buffer()), id_col, text_col, width, gram)
                yield from _cleaned(tree, tree.covered(late), text_col, with_text, with_spans)
                del tree
                release_memory()

    return answers.mapInArrow(clean, out_schema)


def _cleaned(tree: _Block, covered: np.ndarray, text_col: str, with_text: bool, with_spans: bool):
    table = tree.table
    done = 0
    for w in K.words(tree.texts, K.BLANK_EXACT):
        gone = covered[done : done + len(w.start)]
        done += len(w.start)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
        kept = _joined(w, ~gone)
        part = table.slice(w.lo, w.hi - w.lo)
        if with_text:
            texts = [t if not r else k.decode("utf-8", "replace") for t, r, k in zip(part[text_col].to_pylist(), removed.tolist(), kept)]
            part = part.set_column(part.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))
        else:
            part = part.drop_columns([text_col])
        part = part.append_column("n_words", pa.array(np.diff(w.first), pa.int64())).append_column(
            "n_removed", pa.array(removed, pa.int64())
        )
        part = part.append_column("kept_sha256", pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
        if with_spans:
            spans = []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
                spans.append([{"first": int(x), "past": int(y)} for x, y in edge.reshape(-1, 2)])
            part = part.append_column("repeats", pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))))
        yield from part.combine_chunks().to_batches()
