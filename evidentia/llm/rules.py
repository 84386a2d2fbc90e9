"""Quality rules whose combinations an isolation forest judges.

Every text becomes counts: words, code points in words, symbols, repeated lines, words in repeated windows. Base
rules fail the extremes. Of the others an isolation forest on rates of those counts tells how few random splits set a
document apart: trees grow on random rows of the whole corpus, PSI a tree, each row drawn for each tree by a hash,
so a tree's rows are as many at every size of the corpus. The score is the usual 2 ** (-mean path / expected path).
A row's cause is the rate whose splits did most to set it apart: the greatest sum of log2(rows above / rows below the split).
Every cause has a threshold of its own, as what is odd need not be bad: the one that parts labelled rows best while at
most CLEAN_LOSS of those of label 1 go over all causes. Thresholds are read off counts by cause, score and label in BINS equal
steps of the score, which cover all labelled rows.

Defined results: null and empty texts have no words and fail the base rules. Without labelled rows of both labels nothing is
removed beyond the base rules. Rows without id take part like others. Equal rows get equal results; labels other
than 0 and 1 and of null ids teach nothing, a label counts as often as it is given. Extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import kernel as K
from evidentia.llm.storage import prepare, trimmed, written

WINDOW = 8
FEWEST_WORDS, REPEAT_PERCENT = 20, 30
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
TREES, PSI = 100, 256
BINS = 4096
#: Most of the labelled rows of label 1 that a threshold may remove.
CLEAN_LOSS = 0.01
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest splits on: rates, so that a text's length alone sets nothing apart.
RATES = ["mean_word", "symbols", "dup_lines", "repeat_words"]


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between each place in bounds and the next."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[bounds])


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """For every key whether an equal one stands before it."""
    return K.first_of(keys) != np.arange(len(keys))


def _repeat_words(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Words of each text in windows of `width` words that occur twice or more in it."""
    n, texts = len(hashes), len(first) - 1
    if n < width:
        return np.zeros(texts, np.int64)
    text = np.repeat(np.arange(texts), np.diff(first))
    whole = text[: n - width + 1] == text[width - 1 :]
    at = np.flatnonzero(whole)
    keys = K.mix64(K.windows(hashes, width)[at] + K.mix64(text[at].astype(np.uint64) + np.uint64(1)))
    own = K.first_of(keys)
    often = np.bincount(own, minlength=len(keys))[own] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[often], 1)
    np.add.at(edge, at[often] + width, -1)
    return _per_text(np.cumsum(edge[:-1]) > 0, first)


def _dup_lines(w: K.Words) -> np.ndarray:
    """Lines with a word that equal an earlier one of their text."""
    if not len(w.buf):
        return np.zeros(len(w.bounds) - 1, np.int64)
    ends = w.buf == 10
    head = np.zeros(len(w.buf) + 1, bool)
    head[1:] = ends
    head[w.bounds[:-1]] = True
    head[-1] = False
    start = np.flatnonzero(head)
    stop = np.append(start[1:], len(w.buf))
    stop = stop - ends[np.maximum(stop - 1, 0)]  # without its line end
    lines = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
    start, stop = start[lines], stop[lines]
    text = np.searchsorted(w.bounds, start, side="right") - 1
    keys = K.span_hashes(w.buf.astype(np.uint64) + np.uint64(1), start, stop)
    keys = K.mix64(keys + K.mix64(text.astype(np.uint64) + np.uint64(1)))
    return np.bincount(text[_seen_before(keys)], minlength=len(w.bounds) - 1)


def counts(column) -> dict[str, np.ndarray]:
    """COUNTS of every text of a column."""
    symbol = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
    out = {name: [np.zeros(0, np.int64)] for name in COUNTS}
    for w in K.words(column, K.BLANK_EXACT):
        begins = (w.buf & 0xC0) != 0x80  # a code point begins
        rows = {
            "n_words": np.diff(w.first), "word_chars": _per_text(begins & K.BLANK_EXACT.member[w.buf], w.bounds),
            "n_symbols": _per_text(symbol[w.buf], w.bounds), "n_dup_lines": _dup_lines(w),
            "n_repeat_words": _repeat_words(w.hash, w.first, WINDOW)
        }
        for name, values in rows.items():
            out[name].append(values)
    return {name: np.concatenate(values) for name, values in out.items()}


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, base_failed) of every row, as a table in the shared folder."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in trimmed(batches):
            found = counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[c], pa.int64()) for c in COUNTS]], names=["id", *COUNTS])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS]])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return written(rows.withColumn("base_failed", failed), "counts")


def rates() -> list:
    """RATES from COUNTS, as columns."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbols"),
        (F.col("n_dup_lines") / words).alias("dup_lines"),
        (F.col("n_repeat_words") / words).alias("repeat_words"),
    ]


# --- the forest ---------------------------------------------------------------


def expected_path(n) -> np.ndarray:
    """The mean path of an unsuccessful search in a binary tree of n rows, by which paths are measured."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    harmonic = np.log(m - 1) + 0.5772156649015329 + 0.5 / (m - 1)
    return np.where(n > 2, 2 * harmonic - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class Tree:
    """Random splits until rows stand alone, are all alike, or the mean depth of a balanced tree is reached.

    Node i splits on column[i] at value[i]; below it are child[i] and child[i] + 1. A leaf has column -1 and its path in value.
    gain[i] has for every column what its splits above node i did to set its rows apart.
    """

    def __init__(self, rows: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        limit = math.ceil(math.log2(max(len(rows), 2)))
        self.column, self.value, self.child, self.gain = [-1], [0.0], [0], [[0.0] * rows.shape[1]]
        waiting = [(0, np.arange(len(rows)), 0)]
        while waiting:
            node, mine, depth = waiting.pop()
            low, high = (f(rows[mine], axis=0) if len(mine) else np.zeros(rows.shape[1]) for f in (np.min, np.max))
            open_ = np.flatnonzero(high > low)
            if depth >= limit or not len(open_):
                self.value[node] = depth + float(expected_path(len(mine)))
                continue
            column = int(rng.choice(open_))
            cut = float(rng.uniform(low[column], high[column]))
            left = rows[mine, column] <= cut
            self.column[node], self.value[node], self.child[node] = column, cut, len(self.column)
            for part in (mine[left], mine[~left]):
                waiting.append((len(self.column), part, depth + 1))
                self.column.append(-1)
                self.value.append(0.0)
                self.child.append(0)
                gain = list(self.gain[node])
                gain[column] += math.log2(len(mine) / max(len(part), 0.5))
                self.gain.append(gain)

    def paths(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The path of every row, and the gain of each column on it."""
        column, value, child = np.array(self.column), np.array(self.value), np.array(self.child)
        node = np.zeros(len(rows), np.int64)
        while len(on := np.flatnonzero(column[node] >= 0)):
            at = node[on]
            node[on] = child[at] + (rows[on, column[at]] > value[at])
        return value[node], np.array(self.gain)[node]


def grown(rows: DataFrame, n: int, trees: int = TREES, psi: int = PSI, seed: int = 7) -> list[Tree]:
    """A forest on (key, RATES): every tree on about psi of the n rows; with fewer rows all of them.

    A row's key decides which trees it is drawn for. Trees grow in tasks of their own; the driver gets them as splits, 2 * psi a tree.
    """
    share = F.lit(int(min(1.0, psi / max(n, 1)) * (1 << 32)))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("key", t), F.lit(1 << 32)) < share)

    def grow(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        x = np.stack([table[c].to_numpy() for c in RATES], axis=1)
        t = Tree(x[np.lexsort(x.T)], seed * 1000 + tree)  # in an order of their own, however they came
        return pa.table(
            {
                "tree": pa.array([tree], pa.int32()), "column": pa.array([t.column], pa.list_(pa.int32())),
                "value": pa.array([t.value], pa.list_(pa.float64())), "child": pa.array([t.child], pa.list_(pa.int32())),
                "gain": pa.array([np.ravel(t.gain)], pa.list_(pa.float64()))
            }
        )

    sample = rows.select(F.explode(drawn).alias("tree"), *RATES)
    kind = "tree int, column array<int>, value array<double>, child array<int>, gain array<double>"
    out = []
    for r in sample.groupBy("tree").applyInArrow(grow, kind).orderBy("tree").collect():
        t = Tree(np.zeros((0, len(RATES))), 0)
        t.column, t.value, t.child, t.gain = r["column"], r["value"], r["child"], np.reshape(r["gain"], (-1, len(RATES))).tolist()
        out.append(t)
    return out


def anomaly(forest: list[Tree], x: np.ndarray, psi: int) -> tuple[np.ndarray, np.ndarray]:
    """The forest's score of each row of x, towards 1 where few splits set it apart and below 0.5 within the crowd; and its cause."""
    path, gain = np.zeros(len(x)), np.zeros((len(x), len(RATES)))
    for t in forest if len(x) else ():
        p, g = t.paths(x)
        path += p
        gain += g
    if not forest:
        return path, np.zeros(len(x), np.int32)
    return 2.0 ** (-path / len(forest) / max(float(expected_path(psi)), 1e-9)), gain.argmax(axis=1).astype(np.int32)


def thresholds(bins: list[tuple[int, int, int, int]], clean_loss: float = CLEAN_LOSS) -> list[float]:
    """By cause, the score from which rows go, of (cause, bin, rows of label 1, rows of label 0): the greatest share of label 0
    less that of label 1 goes, and of label 1 no more than each cause's part of clean_loss; infinity where that removes nothing."""
    good, bad = sum(b[2] for b in bins), sum(b[3] for b in bins)
    cuts = [math.inf] * len(RATES)
    for cause in range(len(RATES) if good and bad else 0):
        best, lost, caught = 0.0, 0, 0
        for _, k, g, b in sorted((x for x in bins if x[0] == cause), reverse=True):
            lost, caught = lost + g, caught + b
            if lost > clean_loss / len(RATES) * good:
                break
            if caught / bad - lost / good > best:
                best, cuts[cause] = caught / bad - lost / good, k / BINS
    return cuts


def judged(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", trees: int = TREES,
    psi: int = PSI, clean_loss: float = CLEAN_LOSS
) -> DataFrame:
    """(id_col, COUNTS, base_failed, kept, score, cause): kept where neither a base rule fails nor the score reaches its cause's threshold.

    Labels of ids whose crc32 as text is a multiple of 5 are not read, so the verdict can be held against them.
    """
    spark = docs.sparkSession
    rows = measured(docs, id_col, text_col).select("*", F.xxhash64("id", *COUNTS).alias("key"), *rates())
    usable = rows.where(~F.col("base_failed"))
    n = usable.count()
    forest = spark.sparkContext.broadcast(grown(usable, n, trees, psi))  # trees * 2 * psi splits
    size = min(psi, n)

    def score(batches):
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[-len(RATES) :]], axis=1)
            score, cause = anomaly(forest.value, x, size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: -len(RATES)], pa.array(score, pa.float64()), pa.array(cause, pa.int32())],
                names=[*batch.schema.names[: -len(RATES)], "score", "cause"]
            )

    held = ["id", *COUNTS, "base_failed"]
    schema = T.StructType([*[rows.schema[c] for c in held], T.StructField("score", T.DoubleType()), T.StructField("cause", T.IntegerType())])
    scored = written(rows.select(*held, *RATES).mapInArrow(score, schema), "scores")
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("y in (0, 1)")
    learned = scored.where(~F.col("base_failed")).join(y, "id").where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) != 0)
    step = F.floor(F.col("score") * BINS).cast("int").alias("bin")
    bins = learned.groupBy("cause", step).agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).collect()  # BINS a cause at most
    cuts = thresholds([tuple(r) for r in bins], clean_loss)
    kept = ~F.col("base_failed") & (F.col("score") < F.array(*map(F.lit, cuts))[F.col("cause")])
    cause = F.array(*map(F.lit, RATES))[F.col("cause")]
    return scored.select(F.col("id").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"), F.round("score", 9).alias("score"), cause.alias("cause"))
