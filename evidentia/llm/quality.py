"""Document quality by kernel ridge regression on document statistics.

Every text becomes a vector of statistics. Random Fourier features (a seeded draw)
approximate a Gaussian kernel on the standardised vectors; ridge weights solve the normal
equations, which are summed per partition and then by row of the matrix, so that
only matrices of the size of the features travel. An isotonic fit on rows that
the ridge fit has not seen turns its values into probabilities of label 1.

Defined results: null and empty texts have the statistics of an empty text and get its
score, and so do no documents for an empty table. Without usable labels every score is 0.5; with one label only, 0 or 1.
A label counts as often as it is given, and a row of documents as often as it occurs; labels other than 0 and 1 and
null ids teach nothing. Statistics are of whole texts and not clipped. Extra columns are not read.
The calibration takes ridge values in BINS equal steps from -0.5 to 1.5, those beyond as at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import kernel as K
from evidentia.llm.storage import partitions, prepare, trimmed, written

FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-3
BINS = 2048
THRESHOLD = 0.3
_BYTES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (9, 10, 11, 12, 13, 32), "line": (10,), "stop": (46,),
    "comma": (44,), "bang": (33, 63), "bar": (124,), "symbol": (*range(35, 39), 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126),
    "beyond": range(128, 256)
}
NAMES = [*_BYTES, "log_words", "log_word_bytes", "long_words", "short_words", "distinct", "again", "top", "shout", "ragged"]


def statistics(column) -> np.ndarray:
    """One row of statistics per text, in the order of NAMES."""
    out = []
    tables = [np.isin(np.arange(256), list(b)).astype(np.int64) for b in _BYTES.values()]
    for w in K.words(column, K.BLANK_LOWER):
        size = np.maximum(np.diff(w.bounds), 1)
        n = np.diff(w.first)
        many = np.maximum(n, 1)
        sums = {}
        for name, table in zip(_BYTES, tables):
            sums[name] = np.diff(np.concatenate([[0], np.cumsum(table[w.buf])])[w.bounds])
        per_text = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[w.first])
        length = w.end - w.start
        again = np.zeros(len(w.hash), np.int64)
        again[1:] = w.hash[1:] == w.hash[:-1]
        distinct, top = _repeats(w.hash, w.first)
        upper = tables[0][w.buf[w.start]] * (tables[0][w.buf[np.maximum(w.end - 3, w.start)]]) if len(w.start) else again
        tail = w.buf[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
        odd = ~((tail >= 128) | ((tail >= 48) & (tail < 58)) | ((tail >= 65) & (tail < 91)) | ((tail >= 97) & (tail < 123)))
        rows = [sums[k] / size for k in _BYTES]
        rows += [
            np.log1p(n), np.log1p(per_text(length) / many), per_text(length > 12) / many, per_text(length < 4) / many, distinct / many,
            per_text(again) / many, top / many, per_text(upper) / many, per_text(odd) / many
        ]
        out.append(np.stack(rows, axis=1))
    return np.concatenate(out).astype(np.float64) if out else np.zeros((0, len(NAMES)))


def _repeats(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of different words of each text, and how often its commonest occurs."""
    distinct, top = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            edges = np.flatnonzero(np.diff(np.sort(hashes[a:b])))
            distinct[k] = len(edges) + 1
            top[k] = np.diff(np.concatenate([[-1], edges, [b - a - 1]])).max()
    return distinct, top


def _draw(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.standard_normal((n, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    matrix, phase = _draw(x.shape[1])
    z = np.sqrt(2 / FEATURES) * np.cos((x - mean) / scale @ matrix + phase)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, len(NAMES)))


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted non-decreasing fit, by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every row, as a table in the shared folder."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in trimmed(batches):
            x = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "x"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return written(docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema), "statistics")


def fit(rows: DataFrame):
    """A model from (x, y, calibrate): y is 0 or 1, calibrate marks rows for the isotonic fit."""
    spark = rows.sparkSession
    x = [F.col("x")[i] for i in range(len(NAMES))]
    sums = rows.agg(F.count("*"), F.avg("y"), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    if not sums[0]:
        return 0.5
    if sums[1] in (0.0, 1.0):
        return float(sums[1])
    mean, scale = np.array(sums[2 : 2 + len(x)]), np.array(sums[2 + len(x) :])
    scale = np.where(scale > 1e-9, scale, 1.0)

    def partial(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = fourier(_matrix(batch.column(0)), mean, scale)
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        yield _rows_of(enumerate(total))

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(row)
        yield _rows_of(sorted(held.items()))

    kind = "i int, row binary"
    normal = rows.where("not calibrate").select("x", "y").mapInArrow(partial, kind).repartition(partitions(spark), "i").mapInArrow(
        summed, kind
    )
    matrix = np.zeros((FEATURES + 1, FEATURES + 2))
    for i, row in normal.collect():  # as many rows as features
        matrix[i] = np.frombuffer(row)
    ridge = RIDGE * max(matrix[-1, -2], 1) * np.eye(FEATURES + 1)
    ridge[-1, -1] = 1e-9
    weights = np.linalg.solve(matrix[:, :-1] + ridge, matrix[:, -1])

    def binned(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(_bins(fourier(_matrix(batch.column(0)), mean, scale) @ weights), pa.int32()), batch.column(1)], names=["bin", "y"]
            )

    bins = rows.where("calibrate").select("x", F.col("y").cast("int").alias("y")).mapInArrow(binned, "bin int, y int")
    bins = sorted(bins.groupBy("bin").agg(F.avg("y"), F.count("*")).collect())  # at most BINS rows
    if not bins:
        return mean, scale, weights, np.arange(BINS), np.linspace(0, 1, BINS)
    at, value, weight = (np.array(c, float) for c in zip(*bins))
    return mean, scale, weights, at, isotonic(value, weight)


def _rows_of(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in pairs], pa.int32()), pa.array([r.tobytes() for _, r in pairs], pa.binary())], names=["i", "row"]
    )


def _bins(values: np.ndarray) -> np.ndarray:
    return np.clip((values + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)


def scored(rows: DataFrame, model) -> DataFrame:
    """(id, score) for (id, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            m = shared.value
            if isinstance(m, float):
                score = np.full(batch.num_rows, m)
            else:
                mean, scale, weights, at, value = m
                score = np.interp(_bins(fourier(_matrix(batch.column(1)), mean, scale) @ weights), at, value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0, 1), pa.float64())], names=["id", "score"])

    return rows.select("id", "x").mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())]))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = THRESHOLD
) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs.

    Rows whose crc32 of the id as text is a multiple of 5 are held out: their labels are not
    read. Of the others, remainder 1 calibrates and the rest fit the ridge.
    """
    rows = measured(docs, id_col, text_col)
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5))
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("y in (0, 1)")
    usable = rows.join(y, "id").where(fold != 0).select("x", "y", (fold == 1).alias("calibrate"))
    model = fit(written(usable, "labelled"))
    out = scored(rows, model)
    return out.select(
        F.col("id").alias(id_col), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted")
    )
