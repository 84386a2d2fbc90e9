"""Typed scans and sinks."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.sources.matrix import read_matrix, write_matrix  # noqa: F401
from evidentia.sources.storage import file_system, kept, shared_folder  # noqa: F401

MANIFEST = "snapshot_id string, source_path string, source_url string, doc_id string, language string, license string, attribution string, allowed boolean"
SECTIONS = "snapshot_id string, doc_id string, section_id string, section_index int, doc_title string, heading string, section_path array<string>, source_path string, source_url string, license string, attribution string, language string, start_offset int, end_offset int, text string"
CHUNKS = "snapshot_id string, doc_id string, section_id string, chunk_id string, section_index int, chunk_index int, doc_title string, section_path array<string>, source_path string, source_url string, license string, attribution string, language string, start_offset int, end_offset int, token_count int, text string"
VECTORS = "row_index int, chunk_id string, vector array<float>"
QUERIES = "query_id string, snapshot_id string, question string, category string, notes string, answerable boolean, tags array<string>, doc_ids array<string>, expected_section_ids array<string>, expected_chunk_ids array<string>"
QUERY_SET = "dataset_name string, dataset_version string, snapshot_id string, row_count long, doc_count long, section_id_count long, chunk_id_count long, default_chunking map<string,int>, notes string"
REGISTRY = "snapshot_id string, source_manifest_path string, doc_ids array<string>, section_ids array<string>, chunk_ids array<string>, default_chunking map<string,int>"
CONTEXTS = "doc_id string, chunk_id string, text string, start_offset int, end_offset int"
HITS = "array<struct<chunk_id:string,score:double,rank:int,doc_id:string,section_id:string,metadata:map<string,int>>>"
RESULTS = f"run_id string, query_id string, snapshot_id string, retriever_name string, retriever_type string, top_k int, answerable boolean, expected_chunk_ids array<string>, hit boolean, recall double, reciprocal_rank double, latency_ms double, hits {HITS}"
SUMMARY = "run_id string, queries long, answerable long, unanswerable long, relevant long, with_results long, without_results long, hit_at_k double, recall_at_k double, mrr double, average_latency_ms double, p50_latency_ms double, p95_latency_ms double, max_latency_ms double"
EMBEDDINGS = "artifact_version string, source_chunks_path string, embedding_model_name string, vector_dimension long, row_count long, snapshot_id string, vectors_path string"
ROW_MAPPING = "row_index int, chunk_id string"
EMBEDDING_MAP = "model_name string, vectors_by_text map<string,array<double>>"
QUESTIONS = "request_id string, question string"
INDEX = "backend_name string, metric string, vector_dimension long, row_count long, embedding_model_name string, snapshot_id string"
RUNTIME = "runtime_id string, snapshot_id string, embedding_model_name string, vector_dimension long, row_count long, version string"
RUNTIME_NAMES = [part.split()[0] for part in RUNTIME.split(", ")]
# Fields that logs must not carry, and the keys of the gate's settings.
SENSITIVE = (
    "content", "final_answer", "model_output", "output_text", "prompt", "question", "raw_output", "response_text", "retrieved_text",
    "system_prompt", "text", "user_prompt"
)
THRESHOLDS = {
    "k": "k", "T_top1": "top1", "T_mean3": "mean3", "T_support": "support", "N_support": "n_support", "L_thin_max": "thin",
    "T_nohit": "no_hit"
}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped and a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of the lines of JSONL files that hold no JSON object; lines count from 1, blank ones too.

    A line's number is its place within its split, plus the lines of the file's earlier splits:
    only one row a split is shuffled, never the lines.
    """
    file, at = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split")
    lines = spark.read.text(path).select(file, at, F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))
    splits = lines.groupBy("path", "split").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    other = splits.select("path", F.col("split").alias("earlier"), F.col("lines").alias("before"))
    starts = splits.join(other, "path").groupBy("path", "split", "first").agg(
        F.sum(F.when(F.col("earlier") < F.col("split"), F.col("before")).otherwise(0)).alias("before")
    )
    text = X.stripped(F.col("text"))
    broken = (text != "") & (F.try_parse_json(text).isNull() | ~text.startswith("{"))
    rows = lines.where(broken).join(starts, ["path", "split"])
    return rows.select("path", (F.col("n") - F.col("first") + F.col("before") + 1).alias("line"), "text")


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_jsonl of files whose every line is an object; else an error that names the first bad lines."""
    wrong = bad_lines(spark, path).orderBy("path", "line").limit(5).collect()
    if wrong:
        raise ValueError("no JSON object at " + ", ".join(f"{r.path}:{r.line}" for r in wrong))
    return read_jsonl(spark, path, schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Run results as JSONL with their fields by name."""
    write_jsonl(results.select(*sorted(results.columns)), path)


def write_summary(summary: DataFrame, name: str, path: str) -> None:
    """A run's summary as one JSON object, its fields by name."""
    row = summary.first().asDict()  # one row
    write_json_object(summary.sparkSession, {"run_id": name, **row}, ", ".join(sorted(SUMMARY.split(", "))), path)


def read_summary(spark: SparkSession, path: str) -> dict:
    """A run's summary; anything but one object is an error."""
    rows = read_json_object(spark, path, SUMMARY).take(2)
    if len(rows) != 1 or rows[0].run_id is None:
        raise ValueError(f"no run summary at {path}")
    return rows[0].asDict()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_objects(spark, path, RESULTS)


def read_json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for one object; an array of objects gives a row each."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON object; any other number of rows is an error."""
    if len(report.take(2)) != 1:
        raise ValueError("a report is one row")
    report.select(*sorted(report.columns)).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_object(spark: SparkSession, record: dict, schema: str, path: str) -> None:
    """One record of known fields; those that record lacks are null."""
    names = spark.createDataFrame([], schema).columns
    row = spark.createDataFrame([tuple(record.get(n) for n in names)], schema)
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, CHUNKS)
    if rows.isEmpty():
        raise ValueError(f"no chunks at {path}")
    return rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, MANIFEST)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, SECTIONS)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question) of requests as JSONL; a request without a question is an error when read."""
    rows = read_jsonl(spark, path, QUESTIONS)
    blank = F.raise_error(F.lit("a request has no question")).cast("string")
    return rows.select(
        X.request_id(F.col("request_id")).alias("query_id"),
        F.when(X.blank(F.col("question")), blank).otherwise(X.stripped(F.col("question"))).alias("question")
    )


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    return read_json_object(spark, path, CONTEXTS)


def read_registry(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(snapshot_id and default_chunking, (kind, id) of what the registry knows)."""
    row = read_json_object(spark, path, REGISTRY)
    of = lambda kind: row.select(F.lit(kind).alias("kind"), F.explode(f"{kind}_ids").alias("id"))
    head = row.select("snapshot_id", "default_chunking").first()
    return head.asDict(), of("doc").union(of("section")).union(of("chunk"))


def read_query_set(spark: SparkSession, path: str, metadata_path: str) -> tuple[DataFrame, dict]:
    """(labelled queries, their metadata record)."""
    return read_objects(spark, path, QUERIES), read_json_object(spark, metadata_path, QUERY_SET).first().asDict()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of every file below folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of whole files."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of whole files below root; paths are relative to it."""
    files, at = file_system(spark, root)
    base = files.getFileStatus(at).getPath().toUri().getPath().rstrip("/") + "/"
    texts = read_texts(spark, root)
    return texts.select(F.substring_index("path", base, -1).alias("path"), "text")


def write_embedding_metadata(spark: SparkSession, about: dict, path: str) -> None:
    """One JSON object that says what vectors are of: the fields of EMBEDDINGS."""
    write_json_object(spark, about, EMBEDDINGS, path)


def read_embedding_metadata(spark: SparkSession, path: str) -> dict:
    rows = read_json_object(spark, path, EMBEDDINGS).take(2)
    if len(rows) != 1 or rows[0].row_count is None:
        raise ValueError(f"no embedding metadata at {path}")
    return rows[0].asDict()


def write_row_mapping(mapping: DataFrame, path: str) -> None:
    """(row_index, chunk_id): which chunk the vector of each row is of."""
    write_jsonl(mapping.select("row_index", "chunk_id"), path)


def read_row_mapping(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, ROW_MAPPING)


def read_embedding_map(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(model name, (text, vector)) of a JSON object; texts must not be blank and vectors must share one width."""
    row = read_json_object(spark, path, EMBEDDING_MAP)
    head = row.select("model_name").take(2)
    if len(head) != 1 or not (head[0].model_name or "").strip():
        raise ValueError(f"no embedding map at {path}")
    rows = row.select(F.explode("vectors_by_text").alias("text", "vector")).select(X.stripped(F.col("text")).alias("text"), "vector")
    size = F.coalesce(F.size("vector"), F.lit(0))
    facts = rows.agg(
        F.count("*").alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.count(F.when(X.blank(F.col("text")), 1)).alias("blank")
    ).first()
    if not facts.n or facts.blank or facts.lo <= 0 or facts.lo != facts.hi:
        raise ValueError(f"{facts.n} texts, {facts.blank} of them blank, with vectors of {facts.lo} to {facts.hi} components")
    return head[0].model_name.strip(), rows


def write_embedding_map(known: DataFrame, model_name: str, path: str) -> None:
    """(text, vector) as one JSON object; a map of this kind is small, and larger ones are tables."""
    rows = known.agg(F.map_from_entries(F.collect_list(F.struct("text", F.col("vector").cast("array<double>")))).alias("vectors_by_text"))
    rows.select(F.lit(model_name).alias("model_name"), "vectors_by_text").coalesce(1).write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str) -> dict:
    """The gate's settings of a YAML file, as the arguments of its thresholds; scores must be of the unit interval."""
    lines = [r.value.split("#")[0].rstrip() for r in spark.read.text(path).coalesce(1).collect()]  # a settings file
    start = next((i for i, line in enumerate(lines) if line.strip() == "retrieval_sufficiency:"), None)
    if start is None:
        raise ValueError("no retrieval_sufficiency settings")
    indent = len(lines[start]) - len(lines[start].lstrip())
    found = {}
    for line in lines[start + 1 :]:
        if line.strip() and len(line) - len(line.lstrip()) <= indent:
            break
        key, _, value = line.strip().partition(":")
        found[key] = value.strip()
    if found.get("score_normalization", "unit_interval") != "unit_interval":
        raise ValueError("the gate takes unit scores")
    lacking = [k for k in THRESHOLDS if k not in found]
    if lacking:
        raise ValueError(f"settings lack {lacking}")
    return {name: (int if key in ("k", "N_support", "L_thin_max") else float)(found[key]) for key, name in THRESHOLDS.items()}


def redacted(events: DataFrame, names: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Events with a mark in place of what logs must not carry; null stays null."""
    return events.select(*[F.when(F.col(c).isNotNull(), "[redacted]").alias(c) if c.lower() in names else F.col(c) for c in events.columns])


def log_line(event: str, names: tuple[str, ...] = SENSITIVE, **fields) -> str:
    """One line of JSON for the driver's log: time, event, and fields, those of sensitive names marked at any depth."""

    def safe(value):
        if isinstance(value, dict):
            return {k: "[redacted]" if k.lower() in names and v is not None else safe(v) for k, v in value.items()}
        return [safe(v) for v in value] if isinstance(value, (list, tuple)) else value

    return json.dumps(
        {"time": datetime.datetime.now(datetime.UTC).isoformat(), "event": event, **safe(fields)}, sort_keys=True, default=str
    )
