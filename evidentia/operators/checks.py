"""Checks of a corpus, of a labelled query set and of responses; each finding is a row.

Findings stay a table in a defined order (place, step), since their number grows with the
input; require_none turns them into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from evidentia.functions import text as X

# What every chunk must carry, in the order it is reported, and the warnings. The wording of the
# errors in ingest_errors and query_set_errors is fixed, too.
REQUIRED = (
    "source_url", "license", "attribution", "snapshot_id", "doc_id", "chunk_id", "section_path", "start_offset", "end_offset",
    "token_count", "text"
)
WARNINGS = {
    "manifest": "Manifest was empty.",
    "sections": "No sections were produced.",
    "chunks": "No chunks were produced.",
    "section_docs": "Parsed sections contain doc_ids that were not present in the manifest.",
    "chunk_docs": "Chunks contain doc_ids that were not present in parsed sections.",
}


def missing(df: DataFrame, name: str) -> Column:
    """Whether a field is absent, null, a blank string or an empty list."""
    if name not in df.columns:
        return F.lit(True)
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, StringType):
        return X.blank(c)
    return c.isNull() | (F.size(c) == 0) if isinstance(kind, ArrayType) else c.isNull()


def _whole(df: DataFrame, name: str) -> Column:
    """A field as a whole number, null where it is none."""
    if name not in df.columns:
        return F.lit(None).cast("long")
    c = F.col(name)
    return (X.stripped(c) if isinstance(df.schema[name].dataType, StringType) else c).try_cast("long")


def _identified(df: DataFrame, kind: str, place: str) -> DataFrame:
    """Adds _id (a stand-in by place where the id is missing) and _again, whether it has an earlier place."""
    name = f"{kind}_id"
    stand_in = F.format_string(f"<missing-{kind}-id-%d>", F.col(place).cast("long"))
    own = F.when(missing(df, name), stand_in).otherwise(X.stripped(F.col(name).cast("string")) if name in df.columns else stand_in)
    return _again(df.withColumn("_id", own), "_id", place)


def _again(df: DataFrame, key: str, place: str) -> DataFrame:
    """Adds _again: first places are summed up before the shuffle, so an id of very many rows is no sort of one task."""
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(place).alias("_first"))
    return df.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(
        "_again", F.col(place) > F.col("_first")
    ).drop("_key", "_first")


def _findings(rows: DataFrame, part: int, place: str, texts: list[Column]) -> DataFrame:
    out = rows.select(
        F.lit(part).alias("part"), F.col(place).cast("long").alias("place"), F.posexplode(F.array(*texts)).alias("step", "message")
    )
    return out.where("message is not null")


def ingest_errors(sections: DataFrame, chunks: DataFrame, place: str = "place") -> DataFrame:
    """(part, place, step, message): errors of sections (part 0) and of chunks (part 1).

    place is the 1-based position of a record in its input. Rows of one id are ordered by
    it, and every one but the first is a duplicate. Columns that are not there are missing.
    """
    s, c = _identified(sections, "section", place), _identified(chunks, "chunk", place)
    said = lambda test, *parts: F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    own = F.col("_id")
    of_section = [said(missing(s, "text"), "Empty section text: ", own), said(F.col("_again"), "Duplicate section_id: ", own)]
    of_chunk = [said(missing(c, "text"), "Empty chunk text: ", own), said(F.col("_again"), "Duplicate chunk_id: ", own)]
    of_chunk += [said(missing(c, name), f"Missing required metadata '{name}' on chunk ", own) for name in REQUIRED]
    of_chunk.append(said(_whole(c, "start_offset") >= _whole(c, "end_offset"), "Invalid chunk offsets: ", own))
    return _findings(s, 0, place, of_section).union(_findings(c, 1, place, of_chunk))


def _doc_ids(df: DataFrame) -> DataFrame:
    return df.where(~missing(df, "doc_id")).select(X.stripped(F.col("doc_id").cast("string")).alias("doc_id")).distinct()


def ingest_warnings(manifest: DataFrame, sections: DataFrame, chunks: DataFrame) -> list[str]:
    """What is empty, and whether documents appear that the step before did not have."""
    found = [WARNINGS[name] for name, df in (("manifest", manifest), ("sections", sections), ("chunks", chunks)) if df.isEmpty()]
    for name, rows, parents in (("section_docs", sections, manifest), ("chunk_docs", chunks, sections)):
        if not _doc_ids(rows).join(_doc_ids(parents), "doc_id", "left_anti").isEmpty():
            found.append(WARNINGS[name])
    return found


def ingest_quality(manifest: DataFrame, sections: DataFrame, chunks: DataFrame, place: str = "place") -> DataFrame:
    """One row of counters; the errors themselves are ingest_errors."""
    total = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0)).cast("long")
    s, c = _identified(sections, "section", place), _identified(chunks, "chunk", place)
    invalid = F.coalesce(_whole(c, "start_offset") >= _whole(c, "end_offset"), F.lit(False))
    lacking = sum((missing(c, name).cast("long") for name in REQUIRED), F.lit(0))
    of_sections = s.agg(
        F.count("*").alias("section_count"), total(missing(s, "text")).alias("empty_section_count"),
        total(F.col("_again")).alias("duplicate_section_ids")
    )
    of_chunks = c.agg(
        F.count("*").alias("chunk_count"), total(missing(c, "text")).alias("empty_chunk_count"),
        total(F.col("_again")).alias("duplicate_chunk_ids"), total(lacking).alias("missing_metadata_count"),
        total(invalid).alias("_invalid"), total(F.coalesce(_whole(c, "token_count"), F.lit(0))).alias("estimated_token_count")
    )
    first = manifest.agg(F.min_by("snapshot_id", place).alias("snapshot_id"))
    docs = _doc_ids(manifest).agg(F.count("*").alias("document_count"))
    one = first.crossJoin(docs).crossJoin(of_sections).crossJoin(of_chunks)  # four tables of one row
    errors = sum(
        (
            F.col(n) for n in (
                "empty_section_count", "duplicate_section_ids", "empty_chunk_count", "duplicate_chunk_ids", "missing_metadata_count"
            )
        ),
        F.col("_invalid")
    )
    return one.withColumn("error_count", errors).drop("_invalid")


def query_set_errors(entries: DataFrame, metadata: dict, registry: dict, ids: DataFrame, place: str = "place") -> DataFrame:
    """(part, place, step, message) for what is wrong with a labelled query set.

    entries: place, query_id, snapshot_id, answerable and the lists doc_ids, expected_section_ids,
    expected_chunk_ids; metadata: one record; registry: its snapshot_id and default_chunking, and
    ids (kind, id) the documents, sections and chunks it knows, kind being doc, section or chunk.
    """
    rows = _again(entries, "query_id", place)
    lists = {"doc": "doc_ids", "section": "expected_section_ids", "chunk": "expected_chunk_ids"}
    name = F.col("query_id")
    differs = lambda of, value: F.when(
        ~F.col("snapshot_id").eqNullSafe(F.lit(value)),
        F.concat(
            name, F.lit(": entry snapshot_id '"), F.coalesce("snapshot_id", F.lit("")),
            F.lit(f"' does not match {of} snapshot_id '{value}'")
        )
    )
    evidence = (F.coalesce(F.size("expected_section_ids"), F.lit(0)) > 0) | (F.coalesce(F.size("expected_chunk_ids"), F.lit(0)) > 0)
    own = [
        F.when(F.col("_again"), F.concat(F.lit("Duplicate query_id: "), name)),
        differs("metadata", metadata["snapshot_id"]),
        differs("registry", registry["snapshot_id"]),
        F.when(
            F.col("answerable") & ~evidence, F.concat(name, F.lit(": answerable entries must include at least one section or chunk ID"))
        ),
        F.when(~F.col("answerable") & evidence, F.concat(name, F.lit(": unanswerable entries must not include section/chunk IDs"))),
    ]
    out = _findings(rows, 1, place, own)
    known = ids.select("kind", "id").distinct()
    for step, (kind, column) in enumerate(lists.items(), len(own)):
        used = entries.select(F.col(place).cast("long").alias("place"), "query_id", F.posexplode(column).alias("at", "id"))
        unknown = used.join(known.where(F.col("kind") == kind).select("id"), "id", "left_anti")
        out = out.union(
            unknown.select(F.lit(1), "place", F.lit(step), F.concat(name, F.lit(f": unknown {kind}_id '"), F.col("id"), F.lit("'")))
        )
    n = lambda kind: F.coalesce(F.sum((F.col("kind") == kind).cast("long")), F.lit(0))
    counts = entries.agg(F.count("*").alias("entries")).crossJoin(known.agg(*[n(k).alias(k) for k in lists]))  # one row each
    numbers = lambda head, column: F.concat(F.lit(head), F.col(column).cast("string"))
    whole = [
        F.when(
            F.col("entries") != metadata["row_count"],
            numbers(f"Metadata row_count={metadata['row_count']} does not match dataset size=", "entries")
        ),
        F.when(
            F.col("doc") != metadata["doc_count"],
            numbers(f"Metadata doc_count={metadata['doc_count']} does not match registry size=", "doc")
        ),
        F.when(
            F.col("section") != metadata["section_id_count"], F.lit("Metadata section_id_count does not match registry section ID count")
        ),
        F.when(F.col("chunk") != metadata["chunk_id_count"], F.lit("Metadata chunk_id_count does not match registry chunk ID count")),
        F.when(
            F.lit(metadata.get("default_chunking") != registry.get("default_chunking")),
            F.lit("Metadata default_chunking does not match registry default_chunking")
        ),
    ]
    empty = F.when(F.col("entries") == 0, F.lit("Dataset must contain at least one entry."))
    counts = counts.withColumn("_place", F.lit(0))
    return out.union(_findings(counts, 0, "_place", [empty])).union(_findings(counts, 2, "_place", whole))


def require_none(findings: DataFrame, shown: int = 20) -> None:
    """Raises with how many findings there are and the first few of them."""
    first = findings.orderBy("part", "place", "step").limit(shown).select("message").collect()
    if first:
        raise ValueError(f"{findings.count()} findings:\n" + "\n".join(r.message for r in first))


def contract_breaches(responses: DataFrame) -> Column:
    """Why a response (final_answer, citations, is_refusal, reason_code, message) breaks the contract: an array."""
    refusal, cites = F.coalesce("is_refusal", F.lit(False)), F.coalesce(F.size("citations"), F.lit(0))
    no_message = X.blank(F.col("message"))
    bounds = F.coalesce(
        F.exists("citations", lambda c: F.coalesce((c.start_offset < 0) | (c.end_offset <= c.start_offset), F.lit(True))), F.lit(False)
    )
    rules = (
        (X.blank(F.col("final_answer")), "blank_answer"),
        (refusal & (cites > 0), "citations_on_refusal"),
        (~refusal & (cites == 0), "citations_missing"),
        (bounds, "citation_bounds"),
        (refusal & F.col("reason_code").isNull(), "reason_missing"),
        (refusal & no_message, "message_missing"),
        (~refusal & F.col("reason_code").isNotNull(), "reason_without_refusal"),
        (~refusal & F.col("message").isNotNull(), "message_without_refusal"),
    )
    return F.array_compact(F.array(*[F.when(test, code) for test, code in rules]))
