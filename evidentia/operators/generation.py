"""From questions and their hits to answers or refusals, in a bounded number of attempts.

A generator is a callable that takes requests (query_id, question, system_prompt, user_prompt,
attempt) as a DataFrame and returns responses (RESPONSE); it is called once an attempt, with
the requests that are still open. Its rows are written to the shared folder, so no request is
sent again when an executor is lost later on.
"""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import answers, checks, prompts, trust
from evidentia.operators.retrieval import question_key
from evidentia.sources.storage import file_system
from evidentia.sources.tables import kept

RESPONSE = f"query_id string, final_answer string, citations {answers.CITATIONS}, is_refusal boolean, reason_code string, message string, failure_code string"
_CITATION = pa.struct(
    [("marker", pa.string()), ("doc_id", pa.string()), ("chunk_id", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32())]
)
_RESPONSE = pa.schema(
    [
        ("query_id", pa.string()), ("final_answer", pa.string()), ("citations", pa.list_(_CITATION)), ("is_refusal", pa.bool_()),
        ("reason_code", pa.string()), ("message", pa.string()), ("failure_code", pa.string())
    ]
)
PARSE_ERROR = "parse_error"
# The fields of a reply, its reasons to refuse, and where two kinds of servers take requests.
REPLY = {"final_answer", "citations", "refusal"}
REFUSAL = {"is_refusal", "reason_code", "message"}
CITATION = {"marker": str, "doc_id": str, "chunk_id": str, "start_offset": int, "end_offset": int}
REASONS = ("insufficient_evidence", "no_relevant_docs", "citation_validation_failed", "out_of_scope")
ENDPOINTS = {"http": "/query", "openai_compatible": "/v1/chat/completions"}

Generator = Callable[[DataFrame], DataFrame]


def worker_generator(connect: Callable[[], Callable[[dict], dict]]) -> Generator:
    """A generator that opens one client a partition by connect(); a client maps a request to the fields of RESPONSE.

    What a client raises becomes the failure_code parse_error (ValueError), timeout (TimeoutError), transport_error
    (other OSError) or backend_error.
    """

    def code(error: Exception) -> str:
        kinds = ((ValueError, PARSE_ERROR), (TimeoutError, "timeout"), (OSError, "transport_error"))
        return next((name for kind, name in kinds if isinstance(error, kind)), "backend_error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = connect()
        for batch in batches:
            out = []
            for request in batch.to_pylist():
                try:
                    row = {**client(request), "query_id": request["query_id"]}
                    pa.RecordBatch.from_pylist([row], schema=_RESPONSE)
                except pa.ArrowException:  # a field of another type
                    row = {"query_id": request["query_id"], "failure_code": PARSE_ERROR}
                except Exception as error:  # a failed request is a row, the job goes on
                    row = {"query_id": request["query_id"], "failure_code": code(error)}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_RESPONSE)

    return lambda requests: requests.mapInArrow(run, RESPONSE)


def _field(record: dict, name: str, *kinds: type):
    value = record[name]
    if not isinstance(value, kinds) or isinstance(value, bool) and bool not in kinds:
        raise ValueError(f"{name} has the wrong type")
    return value


def _fields(reply) -> dict:
    """The fields of RESPONSE from a reply, whose names and types must be exactly those of the contract."""
    if not isinstance(reply, dict) or set(reply) != REPLY:
        raise ValueError(f"a reply has the fields {sorted(REPLY)}")
    refusal = _field(reply, "refusal", dict)
    if set(refusal) != REFUSAL:
        raise ValueError(f"a refusal has the fields {sorted(REFUSAL)}")
    citations = _field(reply, "citations", list)
    for record in citations:
        if not isinstance(record, dict) or set(record) != set(CITATION):
            raise ValueError(f"a citation has the fields {list(CITATION)}")
        for name, kind in CITATION.items():
            _field(record, name, kind)
    reason = _field(refusal, "reason_code", str, type(None))
    if reason is not None and reason not in REASONS:
        raise ValueError(f"unknown reason {reason!r}")
    return {
        "final_answer": _field(reply, "final_answer", str), "citations": citations, "is_refusal": _field(refusal, "is_refusal", bool),
        "reason_code": reason, "message": _field(refusal, "message", str, type(None))
    }


def parsed_reply(content: str) -> dict:
    """The fields of RESPONSE from a model's text: JSON, bare or in a Markdown fence; anything else is a ValueError."""
    text = content.strip()
    fenced = re.fullmatch(r"```[^\n]*\n(.*)\n```", text, re.DOTALL)
    for candidate in (text, *([fenced[1].strip()] if fenced else [])):
        try:
            return _fields(json.loads(candidate))
        except ValueError as error:
            last = error
    raise last


def chat_content(payload) -> str:
    """The text of the first choice of a chat server's reply; text parts are joined by line ends."""
    try:
        content = payload["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError):
        raise ValueError("no choices[0].message.content") from None
    if isinstance(content, list):
        parts = (p.get("text") for p in content if isinstance(p, dict) and str(p.get("type", "")).lower() == "text")
        content = "\n".join(filter(None, (str(p).strip() for p in parts if p is not None)))
    if not isinstance(content, str) or not content.strip():
        raise ValueError("the content is no text")
    return content.strip()


class BackendError(RuntimeError):
    """A server's reply with an error status."""


def http_client(
    base_url: str, dialect: str = "http", model: str | None = None, timeout: float = 30.0, path: str | None = None, key: str | None = None
) -> Callable[[], Callable[[dict], dict]]:
    """connect() for worker_generator: requests as JSON over HTTP.

    The dialect http posts the request and gets a reply; openai_compatible posts messages to a model and gets a chat
    completion whose text holds the reply.
    """
    base = base_url.strip().rstrip("/")
    if not base or dialect not in ENDPOINTS or dialect == "openai_compatible" and not model:
        raise ValueError(f"need a base_url, a dialect of {list(ENDPOINTS)}, and a model for the latter")
    url = base + (path or ENDPOINTS[dialect])
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})

    def body(request: dict) -> dict:
        if dialect == "http":
            return {k: v for k, v in request.items() if v is not None}
        system = [{"role": "system", "content": request["system_prompt"]}] if request.get("system_prompt") else []
        return {
            "model": model, "messages": [*system, {"role": "user", "content": request.get("user_prompt") or request["question"]}],
            "temperature": 0.0
        }

    def ask(request: dict) -> dict:
        post = urllib.request.Request(url, json.dumps(body(request)).encode(), headers, method="POST")
        try:
            with urllib.request.urlopen(post, timeout=timeout) as got:
                text = got.read().decode("utf-8")
        except urllib.error.HTTPError as error:
            raise BackendError(f"HTTP {error.code}") from error
        except urllib.error.URLError as error:
            raise error.reason if isinstance(error.reason, OSError) else OSError(str(error.reason)) from error
        payload = json.loads(text)
        return _fields(payload) if dialect == "http" else parsed_reply(chat_content(payload))

    return lambda: ask


def canned_generator(known: DataFrame) -> Generator:
    """Answers by question, regardless of case and blanks; one that is not known is a backend_error.

    known: question and the fields of RESPONSE but query_id.
    """
    fields = [f for f in ("final_answer", "citations", "is_refusal", "reason_code", "message", "failure_code") if f in known.columns]
    keyed = known.select(question_key(F.col("question")).alias("_key"), F.struct(*fields).alias("_row"))
    # Of several rows of one question the first by its fields.
    by_key = keyed.groupBy("_key").agg(F.min("_row").alias("_row")).select("_key", F.lit(True).alias("_known"), "_row.*")

    def run(requests: DataFrame) -> DataFrame:
        got = requests.select("query_id", question_key(F.col("question")).alias("_key")).join(by_key, "_key", "left")
        have = lambda name, kind: (F.col(name) if name in fields else F.lit(None)).cast(kind).alias(name)
        failure = F.coalesce(have("failure_code", "string"), F.when(F.col("_known").isNull(), "backend_error")).alias("failure_code")
        return got.select(
            F.col("query_id").cast("string").alias("query_id"), have("final_answer", "string"), have("citations", answers.CITATIONS),
            have("is_refusal", "boolean"), have("reason_code", "string"), have("message", "string"), failure
        )

    return run


def sent_once(generate: Generator, ledger: str) -> Generator:
    """generate with a table at `ledger` of what was answered, under a hash of the request (its id, prompts and attempt).

    Responses are in the table before they go on, and a request that has one is not sent again: a driver that starts
    over with the same ledger repeats only the requests of the batch that it was broken off in.
    """

    def run(requests: DataFrame) -> DataFrame:
        spark = requests.sparkSession
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("query_id", "system_prompt", "user_prompt", "attempt")]
        key = F.sha2(F.concat_ws("\x1f", *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)
        keyed = kept(requests.withColumn("request_key", key))
        files, at = file_system(spark, f"{ledger.rstrip('/')}/_SUCCESS")
        new = keyed.join(spark.read.parquet(ledger).select("request_key"), "request_key", "left_anti") if files.exists(at) else keyed
        if not new.isEmpty():
            got = generate(new.drop("request_key")).join(new.select("query_id", "request_key"), "query_id")
            got.write.mode("append").parquet(ledger)
        answered_ = spark.read.parquet(ledger).join(keyed.select("request_key"), "request_key", "left_semi")
        return answered_.select(*[f.name for f in _RESPONSE])

    return run


def answered(
    questions: DataFrame, hits: DataFrame, generate: Generator, thresholds: trust.Thresholds = trust.Thresholds(), attempts: int = 2,
    messages: dict[str, str] | None = None, system_prompt: str | None = None, ledger: str | None = None
) -> DataFrame:
    """(query_id, status, final_answer, citations, reason_code, failure_code, attempts), a row per question.

    questions: query_id, question; hits: query_id, chunk_id, text, start_offset, end_offset, rank, unit score and what else
    prompts.user_prompts shows. ledger names a table in which requests are kept, see sent_once(). The gate refuses first; admitted questions are generated, their citations
    checked and missing ones repaired. A reply that breaks the contract counts as one that could not be parsed. An answer that fails, or that
    could not be parsed, is asked for again up to attempts times and then refused. Any other failure ends as status error. status is answer, refusal or error.
    """
    if attempts <= 0:
        raise ValueError("attempts must be positive")
    texts = messages or answers.MESSAGES
    if ledger:
        generate = sent_once(generate, ledger)
    asked = questions.select(F.col("query_id").cast("string").alias("query_id"), "question")
    hits = kept(hits.withColumn("query_id", F.col("query_id").cast("string")))
    gated = asked.join(trust.gate(hits, thresholds).select("query_id", "decision"), "query_id", "left").withColumn(
        "decision", F.coalesce("decision", F.lit("no_relevant_docs"))
    )
    admitted = F.col("decision").isin("full", "thin")
    none = F.lit(None).cast(answers.CITATIONS)
    said = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    shape = ["query_id", "status", "final_answer", "citations", "reason_code", "failure_code", "attempts"]

    def refused(rows: DataFrame, code: Column, attempt: int) -> DataFrame:
        rows = rows.withColumn("reason_code", code)
        return rows.select(
            "query_id", F.lit("refusal").alias("status"), F.element_at(said, F.col("reason_code")).alias("final_answer"),
            none.alias("citations"), "reason_code", F.lit(None).cast("string").alias("failure_code"), F.lit(attempt).alias("attempts")
        )

    done = refused(gated.where(~admitted), F.col("decision"), 0)
    shown = hits if "doc_id" in hits.columns else hits.withColumn("doc_id", F.lit(None).cast("string"))
    admitted_rows = gated.where(admitted).select("query_id", "question")
    prompted = prompts.user_prompts(admitted_rows, shown)
    left = kept(
        admitted_rows.join(prompted, "query_id").select(
            "query_id", "question", F.lit(system_prompt or prompts.system_prompt()).alias("system_prompt"), "user_prompt"
        )
    )
    spans = hits.select("query_id", "chunk_id", "text", "start_offset", "end_offset")

    for attempt in range(1, attempts + 1):
        got = kept(generate(left.withColumn("attempt", F.lit(attempt))))
        sound = F.size(checks.contract_breaches(got)) == 0
        got = got.withColumn("failure_code", F.coalesce("failure_code", F.when(~sound, PARSE_ERROR)))
        plain = got.where("failure_code is null").withColumnRenamed("final_answer", "answer")
        fixed = kept(answers.repaired(answers.validated(plain, spans, "query_id"), "query_id").drop("failures", "outcome"))
        checked = kept(answers.validated(fixed, spans, "query_id"))
        status = F.when(F.coalesce("is_refusal", F.lit(False)), "refusal").otherwise("answer")
        broken = got.where(F.col("failure_code").isNotNull() & (F.col("failure_code") != PARSE_ERROR))
        rows = checked.where("outcome = 'valid'").select(
            "query_id", status.alias("status"), F.col("answer").alias("final_answer"), "citations", "reason_code", "failure_code",
            F.lit(attempt).alias("attempts")
        )
        rows = rows.union(
            broken.select(
                "query_id", F.lit("error"), F.lit(None).cast("string"), none, F.lit(None).cast("string"), "failure_code", F.lit(attempt)
            )
        )
        rows = rows.union(refused(checked.where("outcome = 'refuse'"), F.lit("citation_validation_failed"), attempt))
        done = done.union(rows)
        left = left.join(rows.select("query_id"), "query_id", "left_anti")
    return done.union(refused(left, F.lit("citation_validation_failed"), attempts)).select(*shape)
