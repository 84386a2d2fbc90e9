"""Embedding texts, vector tables and their indexes, and hits joined to what they point at."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import corpus, retrieval
from evidentia.sources import tables

BACKEND, METRIC = "exact-cosine", "cosine"


def embedded(
    rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "text", out: str = "embedding",
    batch: int = 32
) -> DataFrame:
    """rows with a vector of their text; load() opens the model once a worker, which takes batches of texts.

    Null texts count as empty. A model that returns another number of vectors than it got texts is an error.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            texts, got = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                some = model(texts[at : at + batch])
                if len(some) != len(texts[at : at + batch]):
                    raise ValueError(f"{len(some)} vectors for {len(texts[at : at + batch])} texts")
                got += [list(map(float, v)) for v in some]
            yield pd.Series(got, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text_col)))


def looked_up(rows: DataFrame, known: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """rows with the vector that known (text, vector) has for their text; a text without one is an error when read."""
    by_text = known.groupBy(F.col("text").alias("_text")).agg(F.min("vector").alias(out))  # of several vectors of a text the least
    full = rows.join(by_text, F.col(text_col) == F.col("_text"), "left").drop("_text")
    return full.withColumn(
        out,
        F.coalesce(
            F.col(out),
            F.raise_error(F.concat(F.lit("no vector for text: "), F.coalesce(F.col(text_col), F.lit("null")))).cast("array<float>")
        )
    )


def normalised(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Vectors of length 1; the zero vector stays zero and null stays null."""
    norm = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("_norm", norm).withColumn(
        vec_col, F.transform(vec_col, lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(F.lit(0.0)).cast("float"))
    ).drop("_norm")


def facts(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row: row_count, and the least and greatest dimension."""
    size = F.coalesce(F.size(vec_col), F.lit(-1))
    return vectors.agg(F.count("*").alias("row_count"), F.min(size).cast("long").alias("least"), F.max(size).cast("long").alias("most"))


def dimension(vectors: DataFrame, vec_col: str = "embedding") -> tuple[int, int]:
    """(rows, dimension); no rows, no components or several dimensions are errors."""
    row = facts(vectors, vec_col).first()
    if not row.row_count:
        raise ValueError("no vectors")
    if row.least != row.most or row.least <= 0:
        raise ValueError(f"vectors have {row.least} to {row.most} components")
    return row.row_count, row.least


def write_index(vectors: DataFrame, path: str, model: str = "", snapshot: str | None = None) -> dict:
    """Normalised vectors (row_index, chunk_id, vector) and their metadata below path; returns the metadata."""
    rows, width = dimension(vectors, "vector")
    normalised(vectors.select("row_index", "chunk_id", "vector"), "vector").write.mode("overwrite").parquet(f"{path}/vectors")
    about = {
        "backend_name": BACKEND, "metric": METRIC, "vector_dimension": width, "row_count": rows, "embedding_model_name": model,
        "snapshot_id": snapshot
    }
    tables.write_json_object(vectors.sparkSession, about, tables.INDEX, f"{path}/metadata")
    return about


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of an index whose metadata agree with them."""
    about = tables.read_json_object(spark, f"{path}/metadata", tables.INDEX).first()
    if about.backend_name != BACKEND:
        raise ValueError(f"backend_name must be {BACKEND!r}, got {about.backend_name!r}")
    vectors = spark.read.parquet(f"{path}/vectors")
    rows, width = dimension(vectors, "vector")
    if rows != about.row_count or width != about.vector_dimension:
        raise ValueError(f"metadata say {about.row_count} rows of {about.vector_dimension}, the vectors are {rows} of {width}")
    if vectors.select("chunk_id").distinct().count() != rows:
        raise ValueError("row mapping is not one chunk a row")
    return vectors


def paired(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors by row_index; another number of rows on one side is an error."""
    left, right = chunks.count(), vectors.count()
    if left != right:
        raise ValueError(f"{left} chunks and {right} vectors")
    return chunks.join(vectors.drop("chunk_id"), "row_index")


def with_chunks(hits: DataFrame, chunks: DataFrame, on: str = "chunk_id", strict: bool = True) -> DataFrame:
    """Hits with the fields of their chunks; strict makes a hit without chunk an error when read, else its fields are null.

    By row_index, the chunk_id of both sides must agree where both have one.
    """
    check = on != "chunk_id" and "chunk_id" in hits.columns and "chunk_id" in chunks.columns
    right = chunks.withColumnRenamed("chunk_id", "_chunk_id") if check else chunks
    clash = [c for c in right.columns if c in hits.columns and c != on]
    full = hits.join(right.drop(*clash).withColumn("_there", F.lit(True)), on, "left")
    if strict:
        wrong = F.col("_there").isNull()
        if check:
            wrong = wrong | ~F.col("chunk_id").eqNullSafe(F.col("_chunk_id"))
        unknown = F.raise_error(F.concat(F.lit(f"no chunk for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
        full = full.withColumn(on, F.when(wrong, unknown.cast(hits.schema[on].dataType)).otherwise(F.col(on)))
    return full.drop("_there", "_chunk_id")


def identifier(name: str) -> str:
    """A name that may stand in SQL: letters, digits and underscores, not a digit first; else an error."""
    name = name.strip()
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is no identifier: letters, digits and underscores, and no digit first")
    return name


def write_embeddings(
    chunks: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], model: str, path: str, source: str = "",
    batch: int = 32
) -> dict:
    """Embeds chunks (row_index, chunk_id, snapshot_id, text) and writes vectors and their metadata below path; returns the metadata.

    Another number of vectors than of chunks, and vectors of several widths, are errors.
    """
    expected = chunks.count()
    vectors = embedded(chunks.select("row_index", "chunk_id", "text"), load, "text", "vector", batch).drop("text")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    rows, width = dimension(chunks.sparkSession.read.parquet(f"{path}/vectors"), "vector")
    if rows != expected:
        raise ValueError(f"{rows} vectors for {expected} chunks")
    about = {
        "artifact_version": "v1", "source_chunks_path": source, "embedding_model_name": model, "vector_dimension": width, "row_count": rows,
        "snapshot_id": corpus.single_snapshot(chunks), "vectors_path": "vectors"
    }
    tables.write_embedding_metadata(chunks.sparkSession, about, f"{path}/metadata")
    return about


def guarded(queries: DataFrame, width: int) -> DataFrame:
    """Queries whose vector must have as many components as the index; another number is an error when read."""
    wrong = F.raise_error(F.format_string("a query has %d components, the index " + str(width), F.coalesce(F.size("vector"), F.lit(0))))
    vector = F.when(F.size("vector") == width, F.col("vector")).otherwise(wrong.cast(queries.schema["vector"].dataType))
    return queries.withColumn("vector", vector)


def retriever(vectors: DataFrame, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame]):
    """A retriever for questions: embed (query_id, question) -> (query_id, vector), search, chunks joined, unit scores besides raw ones.

    vectors: chunk_id, vector; chunks: chunk_id and what a hit shall carry.
    """

    _, width = dimension(vectors, "vector")

    def retrieve(queries: DataFrame, k: int) -> DataFrame:
        hits = retrieval.cosine(vectors, guarded(embed(queries), width), k, "chunk_id", "vector").withColumnRenamed("vec_id", "chunk_id")
        scored = hits.withColumn("raw_score", F.col("score")).withColumn("score", retrieval.sound_unit_score(F.col("score")))
        return with_chunks(scored, chunks)

    return retrieve


def smoke_report(
    vectors: DataFrame, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], question: str, k: int = 5, preview: int = 160
) -> DataFrame:
    """(rank, score, chunk_id, doc_title, section_path, source_url, source_path, preview): what one question finds.

    vectors: row_index, chunk_id, vector; chunks the same with their texts; each row's chunk must be that of its vector.
    """
    question = " ".join(question.split())
    if not question or k <= 0 or preview <= 0:
        raise ValueError("need a question, and k and preview must be positive")
    paired(chunks, vectors)
    asked = embed(chunks.sparkSession.createDataFrame([(0, question)], "query_id int, question string"))
    if asked.count() != 1:
        raise ValueError("one question must have one vector")
    asked = guarded(asked, dimension(vectors, "vector")[1])
    hits = retrieval.cosine(vectors, asked, k, "row_index", "vector").withColumnRenamed("vec_id", "row_index")
    full = with_chunks(hits.join(vectors.select("row_index", "chunk_id"), "row_index"), chunks, "row_index")
    return full.select(
        "rank", "score", "chunk_id", "doc_title", X.breadcrumb(F.col("section_path")).alias("section_path"), "source_url", "source_path",
        X.preview(F.col("text"), preview).alias("preview")
    )


def smoke_text(report: DataFrame, question: str) -> str:
    """A smoke report to read; it has k rows."""
    rows = report.orderBy("rank").collect()
    found = [
        f"[{r['rank']}] score={r.score:.6f} chunk_id={r.chunk_id}\n    title: {r.doc_title}\n    section_path: {r.section_path}\n    "
            f"source_url: {r.source_url}\n    preview: {r.preview}" for r in rows
    ]
    return "\n\n".join([f'query: "{" ".join(question.split())}"', *(found or ["No matches returned."])])
