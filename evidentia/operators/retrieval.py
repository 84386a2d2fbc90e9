"""Vector ranking, fusion, canonical hits; inverted.py ranks by terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from evidentia.functions import text as X

K1, B, RRF_K, DEPTH = 1.5, 0.75, 60, 20
#: Rows of a block of vectors or of queries, and queries compared at once within.
BLOCK, AT_ONCE = 8192, 64
#: Stands for a cosine that is not defined; lower than any.
_NONE = -2.0


def ranked(hits: DataFrame, k: int, query: str | list[str] = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best k by (score descending, tie ascending), numbered from 1."""
    if k <= 0:
        raise ValueError("k must be positive")
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine of queries (query_id, vector) against all vectors, to 6 places.

    Zero vectors, and pairs of different lengths or with nulls, score 0.
    """
    return ranked(nearest(vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vector")), queries, k), k, tie="vec_id")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", raw: bool = False) -> DataFrame:
    """(query_id, id, score): each query's k best by cosine to 6 places, then id, of every block of vectors (id, vector).

    Both sides are dealt to blocks of about BLOCK rows; a task holds one block against one other. raw scores are not
    rounded, and null, which comes last, where a cosine is not defined; others are 0 there.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    left = vectors.select(F.col(id_col).alias("vec_id"), F.col("vector").cast("array<double>").alias("v"))
    right = queries.select("query_id", F.col("vector").cast("array<double>").alias("w"))
    n_left, n_right = (max(1, -(-df.count() // BLOCK)) for df in (left, right))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("vec_id", "v", part("vec_id", n_left).alias("m"), every(n_right).alias("q"))
    right = right.select("query_id", "w", every(n_left).alias("m"), part("query_id", n_right).alias("q"))
    types = StructType(
        [
            StructField("query_id", right.schema["query_id"].dataType), StructField(id_col, left.schema["vec_id"].dataType),
            StructField("score", DoubleType())
        ]
    )

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        ours = ours.take(pc.sort_indices(ours, sort_keys=[("vec_id", "ascending")], null_placement="at_start"))
        by_length = _by_length(ours["v"])
        asked, found, scores = [], [], []
        for at in range(0, theirs.num_rows if ours.num_rows else 0, AT_ONCE):
            block = _cosines(
                _by_length(theirs["w"].slice(at, AT_ONCE)), by_length, min(AT_ONCE, theirs.num_rows - at), ours.num_rows, _NONE if raw else 0.0
            )
            rounded = _rounded(block)
            best = _best(rounded, k)
            asked.append(np.repeat(np.arange(at, at + len(best)), best.shape[1]))
            found.append(best.ravel())
            scores.append(np.take_along_axis(block if raw else rounded, best, axis=1).ravel())
        asked, found = (pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (asked, found))
        scores = np.concatenate([np.zeros(0), *scores])
        told = pa.array(scores, from_pandas=False, mask=scores == _NONE if raw else None)
        return pa.table({"query_id": theirs["query_id"].take(asked), id_col: ours["vec_id"].take(found), "score": told})

    return left.groupBy("m", "q").cogroup(right.groupBy("m", "q")).applyInArrow(compare, types)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the places and the matrix of the vectors without nulls."""
    column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).copy()
    holed = np.unique(pc.list_parent_indices(column).to_numpy()[pc.is_null(column.flatten()).to_numpy(zero_copy_only=False)])
    sizes[holed] = 0
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = at, np.asarray(column.take(pa.array(at)).flatten(), dtype=np.float64).reshape(-1, size)
    return out


def _cosines(queries: dict, vectors: dict, n: int, m: int, undefined: float) -> np.ndarray:
    """The cosines of n queries (rows) and m vectors."""
    out = np.full((n, m), undefined)
    for size in queries.keys() & vectors.keys():
        (rows, x), (columns, y) = queries[size], vectors[size]
        with np.errstate(all="ignore"):
            norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
            out[np.ix_(rows, columns)] = np.where(norms == 0, undefined, x @ y.T / norms)
    return out


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Half away from zero to 6 places."""
    with np.errstate(all="ignore"):
        return np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores) + 0.0


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k highest scores of each row, the first of equal ones; NaN is the highest."""
    m = scores.shape[1]
    order = np.where(
        np.isnan(scores), 2_000_000, np.rint(np.clip(np.nan_to_num(scores), -1.5, 1.5) * 1e6)
    ).astype(np.int64) * m - np.arange(m)
    return np.argpartition(-order, k - 1, axis=1)[:, :k] if k < m else np.broadcast_to(np.arange(m), scores.shape)


def unit_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))


def sound_unit_score(score: Column) -> Column:
    """unit_score; a score that is no finite number is an error when read."""
    wrong = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(wrong, F.raise_error(F.lit("a score is not finite")).cast("double")).otherwise(unit_score(score))


def fused(
    first: DataFrame, second: DataFrame, k: int = 5, depth: int = DEPTH, rrf_k: int = RRF_K, id_col: str = "doc_id",
    carried: tuple[str, ...] = ()
) -> DataFrame:
    """Reciprocal-rank fusion of two rank lists, with each one's rank kept.

    carried names columns, such as the document and section of a chunk, of which a hit gets the
    first list's value, or the second's where that is null or not there.
    """
    if rrf_k <= 0 or depth <= 0:
        raise ValueError("rrf_k and depth must be positive")

    def cut(df: DataFrame, name: str) -> DataFrame:
        extra = [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(f"{name}_{c}") for c in carried]
        return df.where(F.col("rank") <= max(k, depth)).select("query_id", id_col, F.col("rank").alias(f"{name}_rank"), *extra)

    both = cut(first, "first").join(cut(second, "second"), ["query_id", id_col], "full_outer")
    gain = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(1 / (rrf_k + F.greatest(F.lit(1), F.col(c))))
    both = both.withColumns({c: F.coalesce(f"first_{c}", f"second_{c}") for c in carried}).drop(
        *[f"{n}_{c}" for n in ("first", "second") for c in carried]
    )
    return ranked(both.withColumn("score", gain("first_rank") + gain("second_rank")), k, tie=id_col)


def canonical(hits: DataFrame, k: int, id_col: str = "doc_id", place: str | None = None) -> DataFrame:
    """One hit per id, numbered anew and cut at k: by (rank, score descending, id, place), the first is kept.

    Ids of strings are stripped and must not be blank. place names a column with a hit's position in its list, from 0; a
    rank that is not positive counts as position + 1, and is an error when read where there is no position.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    kind = hits.schema[id_col].dataType
    own = X.stripped(F.col(id_col)) if isinstance(kind, StringType) else F.col(id_col)
    blank = F.coalesce(own.cast("string") == "", F.lit(True))
    own = F.when(blank, F.raise_error(F.lit("a hit has no id")).cast(kind)).otherwise(own)
    unplaced = F.raise_error(F.lit("a hit has neither rank nor position")).cast("long")
    at = F.when(F.col("rank") > 0, F.col("rank").cast("long")).otherwise(F.col(place).cast("long") + 1 if place else unplaced)
    hits = hits.withColumn("_id", F.col(id_col)).withColumn(id_col, own).withColumn("_rank", at)
    order = [F.asc("_rank"), F.desc("score"), F.asc("_id"), *([F.asc(place)] if place else [])]
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", id_col).orderBy(*order))).where("_n = 1").drop("_n")
    again = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    return again.where(F.col("rank") <= k).drop("_rank", "_id")


# --- retrievers: callables (queries, k) -> (query_id, id, score, rank) for all queries at once ---


def static(hits: DataFrame):
    """Gives the hits that it was given, cut at k; queries without any get none."""
    return lambda queries, k: hits.where(F.col("rank") <= k).join(queries.select("query_id").distinct(), "query_id", "left_semi")


FIXTURES = ("oracle", "first-gold", "empty")


def fixture(name: str):
    """A retriever that knows the answers: all expected ids in order (oracle), the first (first-gold), or none (empty).

    Its queries have the lists expected_chunk_ids and expected_section_ids; where only sections are expected, a hit stands for each.
    """
    name = name.strip().lower()
    if name not in FIXTURES:
        raise ValueError(f"a fixture is one of {', '.join(FIXTURES)}, not {name!r}")

    def retrieve(queries: DataFrame, k: int) -> DataFrame:
        chunk_ids, section_ids = (F.coalesce(c, F.array().cast("array<string>")) for c in ("expected_chunk_ids", "expected_section_ids"))
        none = F.lit(None).cast("string")
        of_chunks = F.transform(chunk_ids, lambda c: F.struct(c.alias("chunk_id"), none.alias("section_id")))
        of_sections = F.transform(
            section_ids, lambda c: F.struct(F.concat(F.lit("section-only::"), c).alias("chunk_id"), c.alias("section_id"))
        )
        gold = F.when(F.size(chunk_ids) > 0, of_chunks).otherwise(of_sections)
        rows = queries.select("query_id", F.posexplode(gold).alias("at", "hit"))
        rows = rows.where("false" if name == "empty" else "at = 0" if name == "first-gold" else F.col("at") < k)
        return rows.select("query_id", "hit.*", (1.0 / (F.col("at") + 1)).alias("score"), (F.col("at") + 1).cast("long").alias("rank"))

    return retrieve


def question_key(question: Column) -> Column:
    """A question regardless of case and blanks."""
    return F.lower(X.collapsed(question))


def known_questions(known: DataFrame) -> DataFrame:
    """(question): the different questions that canned() answers, as it compares them."""
    return known.select(question_key(F.col("question")).alias("question")).distinct()


def canned(known: DataFrame):
    """Hits by question, regardless of case and blanks; a question that is not known has none.

    known: question, rank, score and what else a hit has. queries have question besides query_id.
    """
    keyed = known.select(question_key(F.col("question")).alias("_key"), *[c for c in known.columns if c != "question"])

    def retrieve(queries: DataFrame, k: int) -> DataFrame:
        if k <= 0:
            raise ValueError("k must be positive")
        asked = queries.select("query_id", question_key(F.col("question")).alias("_key"))
        order = Window.partitionBy("query_id").orderBy(F.asc("rank"), F.desc("score"))
        hits = asked.join(keyed, "_key").drop("_key")
        return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    return retrieve


def hybrid(
    dense, lexical, depth: int = DEPTH, rrf_k: int = RRF_K, id_col: str = "chunk_id", carried: tuple[str, ...] = ("doc_id", "section_id")
):
    """A retriever that fuses two others, each asked for the best max(k, depth)."""
    return lambda queries, k: fused(dense(queries, max(k, depth)), lexical(queries, max(k, depth)), k, depth, rrf_k, id_col, carried)
