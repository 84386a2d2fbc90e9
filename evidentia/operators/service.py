"""Settings of the question service, what must be there before it starts, and the parts they choose."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from evidentia.operators import generation, retrieval, runtime, trust, vectors
from evidentia.sources import tables
from evidentia.sources.storage import file_system, kept

RETRIEVAL, GENERATION, EMBEDDERS, TARGETS = ("fixture", "artifact", "sql"), (
    "fixture", "http", "openai_compatible"
), ("local", "fixture"), ("local", "cloud")


@dataclass(frozen=True)
class Settings:
    """What a service runs on. Modes that need something name it, and an unsound combination is an error.

    fixture retrieval answers from hits_path (question and hits), artifact from chunks and an index, sql from the promoted runtime table_prefix.
    """

    retrieval: str = "fixture"
    generation: str = "fixture"
    target: str = "local"
    top_k: int = 8
    hits_path: str | None = None
    answers_path: str | None = None
    chunks_path: str | None = None
    index_path: str | None = None
    embedder: str = "local"
    embedding_map_path: str | None = None
    table_prefix: str = "runtime"
    runtime_id: str | None = None
    base_url: str | None = None
    model: str | None = None
    api_key: str | None = field(default=None, repr=False)
    timeout: float = 30.0
    allowed_origins: str | None = None

    def __post_init__(self):
        for name, known in (("retrieval", RETRIEVAL), ("generation", GENERATION), ("embedder", EMBEDDERS), ("target", TARGETS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is one of {', '.join(known)}, not {getattr(self, name)!r}")
        if self.top_k <= 0 or self.timeout <= 0:
            raise ValueError("top_k and timeout must be positive")
        vectors.identifier(self.table_prefix)
        need = []
        if self.retrieval == "sql":
            need += ["runtime_id", *(["embedding_map_path"] if self.embedder == "fixture" else [])]
        if self.generation == "openai_compatible":
            need += ["base_url", "model"]
        if self.target == "cloud":
            if self.retrieval == "artifact":
                raise ValueError("artifact retrieval is for local runs: use fixture or sql")
            need += ["allowed_origins", *(["base_url"] if self.generation == "http" else [])]
        lacking = [n for n in need if not getattr(self, n)]
        if lacking:
            raise ValueError(f"retrieval {self.retrieval} and generation {self.generation} on {self.target} need {', '.join(lacking)}")


def settings_of(values: Mapping[str, str], prefix: str = "EVIDENTIA_") -> Settings:
    """Settings from texts, such as environment variables; blank ones count as not given."""
    kinds = {"top_k": int, "timeout": float}
    given = {f.name: values.get(prefix + f.name.upper(), "").strip() for f in fields(Settings)}
    return Settings(**{k: kinds.get(k, str)(v) for k, v in given.items() if v})


def readiness(spark: SparkSession, s: Settings) -> list[tuple[str, str, bool]]:
    """(name, path or value, whether it is there) of all that the modes need."""
    there = lambda path: bool(path) and (lambda files, at: files.exists(at))(*file_system(spark, path))
    paths, values = [], []
    if s.retrieval == "fixture":
        paths += ["hits_path"]
    elif s.retrieval == "artifact":
        paths += ["chunks_path", "index_path"]
    else:
        values += ["runtime_id"]
    if s.retrieval != "fixture" and s.embedder == "fixture":
        paths += ["embedding_map_path"]
    if s.generation == "fixture":
        paths += ["answers_path"]
    else:
        values += ["base_url", *(["model"] if s.generation == "openai_compatible" else [])]
    out = [(n, getattr(s, n) or "(unset)", there(getattr(s, n))) for n in paths]
    out += [(n, getattr(s, n) or "(unset)", bool(getattr(s, n))) for n in values]
    if s.retrieval == "sql":
        out.append((f"{s.table_prefix}/CURRENT", "runtime", runtime.exists(spark, s.table_prefix)))
    return out


def require_ready(spark: SparkSession, s: Settings) -> None:
    missing = [f"- {name}: {value}" for name, value, ok in readiness(spark, s) if not ok]
    if missing:
        raise ValueError(f"retrieval {s.retrieval} and generation {s.generation} lack\n" + "\n".join(missing))


Embed = Callable[[DataFrame], DataFrame]


def retriever_of(spark: SparkSession, s: Settings, embed: Embed | None = None):
    """The retriever that the settings choose: questions -> hits with the fields of their chunks and unit scores.

    embed: (query_id, question) -> (query_id, vector); with a fixture embedder it looks questions up.
    """
    if s.retrieval == "fixture":
        return retrieval.canned(spark.read.json(s.hits_path))
    if s.embedder == "fixture":
        _, known = tables.read_embedding_map(spark, s.embedding_map_path)
        embed = lambda asked: vectors.looked_up(asked, known, "question", "vector").select("query_id", "vector")
    if embed is None:
        raise ValueError("a local embedder must be given")
    if s.retrieval == "artifact":
        return vectors.retriever(vectors.read_index(spark, s.index_path), tables.read_chunks(spark, s.chunks_path), embed)
    return lambda questions, k: _from_runtime(spark, s, embed, questions, k)


def _from_runtime(spark: SparkSession, s: Settings, embed: Embed, questions: DataFrame, k: int) -> DataFrame:
    """The version that is current when questions come, for as long as they are answered."""
    with runtime.pinned(spark, s.runtime_id, s.table_prefix) as found:
        return kept(vectors.retriever(found.embeddings, found.chunks, embed)(questions, k))


def generator_of(spark: SparkSession, s: Settings) -> generation.Generator:
    if s.generation == "fixture":
        return generation.canned_generator(spark.read.schema(f"question string, {generation.RESPONSE}").json(s.answers_path))
    return generation.worker_generator(generation.http_client(s.base_url or "", s.generation, s.model, s.timeout, key=s.api_key))


def answering(
    spark: SparkSession, s: Settings, embed: Embed | None = None, thresholds: trust.Thresholds = trust.Thresholds()
) -> Callable[[DataFrame], DataFrame]:
    """Questions (query_id, question) -> answers, by the parts that the settings choose; readers are opened once."""
    retrieve, generate = retriever_of(spark, s, embed), generator_of(spark, s)
    return lambda questions: generation.answered(questions, retrieve(questions, s.top_k), generate, thresholds)


def smoke_artifacts(spark: SparkSession, folder: str) -> Settings:
    """Two chunks with their vectors, index, embedding map and canned answer below folder, and the settings of a service on them."""
    texts = ("A lantern burns oil and gives a steady light.", "A bell is cast from bronze and rings when struck.")
    chunks = [
        (
            "smoke", f"d{i}", f"d{i}-sec-0000", f"d{i}-chk-0000", 0, 0, "Things", ["Things"], f"docs/d{i}.md",
            f"https://docs.example.org/docs/d{i}/", "l", "a", "en", 0, len(t), 10, t
        )
        for i, t in enumerate(texts)
    ]
    rows = spark.createDataFrame(chunks, tables.CHUNKS)
    tables.write_jsonl(rows, f"{folder}/chunks")
    known = [(texts[0], [1.0, 0.0]), (texts[1], [0.0, 1.0]), ("What gives light?", [0.9, 0.1])]
    tables.write_embedding_map(spark.createDataFrame(known, "text string, vector array<double>"), "smoke", f"{folder}/map")
    made = [(i, f"d{i}-chk-0000", known[i][1]) for i in range(2)]
    vectors.write_index(spark.createDataFrame(made, tables.VECTORS), f"{folder}/index", "smoke", "smoke")
    record = [("[1]", "d0", "d0-chk-0000", 0, len(texts[0]))]
    answer = [("What gives light?", None, "A lantern gives light.", record, False, None, None, None)]
    spark.createDataFrame(
        answer, f"question string, {generation.RESPONSE}"
    ).drop("query_id").write.mode("overwrite").json(f"{folder}/answers")
    return Settings(
        retrieval="artifact", top_k=2, embedder="fixture", chunks_path=f"{folder}/chunks", index_path=f"{folder}/index",
        embedding_map_path=f"{folder}/map", answers_path=f"{folder}/answers",
    )
