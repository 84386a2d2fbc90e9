"""The engine's registered queries; oracles.py has the SQL they are held against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.oracles import oracle_sql  # noqa: F401
from evidentia.operators import answers, checks, corpus, evaluation, generation, inverted, prompts, retrieval, runtime, sections, trust, vectors
from evidentia.sources import tables
from evidentia.sources.storage import file_system, fresh_path


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_count(s, d):
    return _t(s, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("n_tokens"))


def chunks(s, d):
    return corpus.chunks(_t(s, d, "documents")).select("doc_id", "chunk_index", "start_offset", "end_offset", "token_count", "chunk_id")


def ingest_report(s, d):
    return corpus.report(corpus.chunks(_t(s, d, "documents")))


def manifest_allowlist(s, d):
    path = F.concat(
        "source", F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".mdx").otherwise(".html")
    )
    rows = _t(s, d, "documents").select("doc_id", path.alias("path"))
    return rows.where(corpus.admitted(F.col("path"), ["src1", "src2", "src3"], ["src2/fr"])).select(
        "doc_id", "path", corpus.doc_id_of(F.col("path")).alias("manifest_id")
    )


def section_offsets(s, d):
    rows = _t(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("section_index", "text"))
    return corpus.section_offsets(rows).select(
        "doc_id", F.col("section_index").cast("long").alias("section_index"), "start_offset",
        F.col("end_offset").cast("long").alias("end_offset")
    )


_indexes: dict[tuple[str, str], str] = {}


def _index(s, d) -> inverted.Inverted:
    """The documents' index, written by the first query of a session that asks it and read by all, until storage.clear()."""
    key = s.sparkContext.applicationId, d
    if key in _indexes:
        files, at = file_system(s, f"{_indexes[key]}/shards/_SUCCESS")
        if files.exists(at):
            return inverted.Inverted(s, _indexes[key])
    _indexes[key] = fresh_path(s, "inverted")
    return inverted.write_index(_t(s, d, "documents"), _indexes[key])


def _items(s, d) -> DataFrame:
    return _t(s, d, "benchmark").withColumnRenamed("item_id", "query_id")


def bm25_index(s, d):
    """What the index knows of every term: in how many documents it is, how often at most, and the shortest of them."""
    return _index(s, d).heads.select(
        "term", F.col("n").alias("n_docs"), F.col("most").cast("long").alias("most"), F.col("shortest").cast("long").alias("shortest")
    )


def bm25_topk(s, d):
    return _index(s, d).search(_items(s, d), 5)[0]


def rrf_topk(s, d):
    index = _index(s, d)
    asked = index.weights(_items(s, d))
    first, second = index.rankings(asked, 20, [(retrieval.K1, retrieval.B), (retrieval.K1, 0.25)])[0]
    both = retrieval.fused(first, second, 5)
    return both.select("query_id", "doc_id", "first_rank", "second_rank", F.round("score", 9).alias("score"), "rank")


def _asked(s, d):
    """The stated set of questions: every vector whose id is divisible by 100."""
    return _t(s, d, "embeddings").where("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"
    )


def _cosine(s, d, k=5):
    return retrieval.cosine(_t(s, d, "embeddings"), _asked(s, d), k)


def cosine_topk(s, d):
    return _cosine(s, d)


def hybrid_topk(s, d):
    """Vectors and documents of one id as chunks, asked by the stated vectors and their documents' first lines."""
    docs = _t(s, d, "documents").withColumnRenamed("doc_id", "chunk_id")
    lines = docs.where("chunk_id % 100 = 0").select(  # no other is asked for
        F.col("chunk_id").alias("query_id"), F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("question")
    )
    asked = _asked(s, d).join(lines, "query_id", "left").select("query_id", "vector", F.coalesce("question", F.lit("")).alias("question"))
    of = docs.select("chunk_id", F.col("source").alias("doc_id"), F.col("lang").alias("section_id"))
    dense = lambda q, k: retrieval.cosine(_t(s, d, "embeddings"), q, k).withColumnRenamed("vec_id", "chunk_id").join(
        of.select("chunk_id", "doc_id"), "chunk_id", "left"
    )
    lexical = lambda q, k: _index(s, d).search(q, k, query_text="question")[0].withColumnRenamed("doc_id", "chunk_id").join(
        of, "chunk_id", "left"
    )
    hits = retrieval.hybrid(dense, lexical)(asked, 5)
    return hits.select(
        "query_id", "chunk_id", "doc_id", "section_id", "first_rank", "second_rank", F.round("score", 9).alias("score"), "rank"
    )


def gate_decisions(s, d):
    return trust.gate(_cosine(s, d, 8).withColumn("score", F.round(retrieval.unit_score(F.col("score")), 6)))


def retrieval_metrics(s, d):
    same = evaluation.Shared(_asked(s, d), _t(s, d, "embeddings"), "label")
    return evaluation.per_query(_cosine(s, d), same, "vec_id")


def canonical_hits(s, d):
    hits = _cosine(s, d)
    doubled = hits.union(hits.withColumn("rank", F.col("rank") + 1))
    return retrieval.canonical(doubled, 4, "vec_id").select("query_id", "vec_id", "score", "rank")


def latency_percentiles(s, d):
    return evaluation.latency(_t(s, d, "events"), "value", "event_type")


def citation_markers(s, d):
    noted = F.concat(F.col("text"), F.lit(" [1] see [two] and ["), F.col("turn").cast("string"), F.lit("]."))
    return trust.markers(_t(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", noted.alias("text"))).select("conv_id", "turn", "valid_markers", "malformed_markers")


def registry(s, d):
    rows = _t(s, d, "documents").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("x"))
    return rows.select("lang", F.array_join("x", ",").alias("sources"))


def duplicate_rows(s, d):
    """Second and later occurrences of a text, in id order."""
    rows = _t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return corpus.occurrences(rows, "digest", "doc_id").where("occurrence > 1").select("doc_id", "occurrence")


def _answers(s, d):
    """Assistant turns as answers: the last sentence of odd conversations' turns cites [1], even ones cite nothing; equal turns are one."""
    rows = _t(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text").distinct()
    key = F.concat_ws("-", "conv_id", "turn", F.substring(F.md5(F.coalesce("text", F.lit("-"))), 1, 8)).alias("answer_id")
    cited = F.when(F.col("conv_id") % 2 == 1, answers.with_marker(F.col("text"), F.lit("[1]"))).otherwise(F.col("text"))
    record = F.array(
        F.struct(
            F.lit("[1]").alias("marker"), F.lit("d").alias("doc_id"), F.lit("c").alias("chunk_id"), F.lit(0).alias("start_offset"),
            F.lit(1).alias("end_offset")
        )
    )
    got = rows.select(
        key, cited.alias("answer"), record.alias("citations"), F.lit(False).alias("is_refusal"), F.lit(None).cast("string").alias("message")
    )
    context = got.select(
        "answer_id", F.lit("c").alias("chunk_id"), F.lit("ab").alias("text"), F.lit(0).alias("start_offset"), F.lit(2).alias("end_offset")
    )
    return got, context


def claims(s, d):
    return answers.claims(_answers(s, d)[0], "answer_id")


def citation_validation(s, d):
    got, context = _answers(s, d)
    codes = F.array_join(F.transform("failures", lambda f: f.code), ",")
    return answers.validated(got, context, "answer_id").select("answer_id", "outcome", codes.alias("codes"))


def citation_repair(s, d):
    got, context = _answers(s, d)
    fixed = answers.repaired(answers.validated(got, context, "answer_id"), "answer_id").drop("failures", "outcome")
    return answers.validated(fixed, context, "answer_id").select("answer_id", "answer", "outcome")


def prompt_context(s, d):
    hits = bm25_topk(s, d).join(_t(s, d, "documents").select("doc_id", "text"), "doc_id")
    return answers.prompt_context(hits, "query_id", "doc_id")


def refusals(s, d):
    decided = _t(s, d, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 0, "insufficient_evidence").when(
            F.col("toxic") == 1, "no_relevant_docs"
        ).otherwise("full").alias("decision")
    )
    return answers.refusals(decided, "doc_id", next_step=" Ask about a documented feature ")


def _built(s, d, head, part, tail=""):
    """Documents written anew with known sections: every line with letters or digits, of these alone, is one, under headings of the levels 1, 2, 3, 1, ..."""
    clean = lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", " "))
    docs = _t(s, d, "documents").select(
        "doc_id", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), clean), lambda x: x != "").alias("lines")
    )
    titled = F.col("doc_id") % 3 == 0
    body = F.array_join(F.transform("lines", lambda x, i: part(x, i % 3 + 1, i)), "")
    return docs.select(
        "doc_id", F.concat(F.when(titled, head(F.col("doc_id").cast("string"))).otherwise(""), body, F.lit(tail)).alias("text")
    )


def _markdown(s, d):
    def part(x, level, i):
        line = F.when(i % 4 == 0, x).when(i % 4 == 1, F.concat(F.lit("- "), x)).when(i % 4 == 2, F.concat(F.lit("> "), x)).otherwise(
            F.concat(F.lit("```\n# "), x, F.lit("\n```"))
        )
        return F.concat(F.repeat(F.lit("#"), level), F.lit(" **Part** "), i.cast("string"), F.lit("\n\n"), line, F.lit("\n\n\n"))

    return _built(s, d, lambda n: F.concat(F.lit('---\ntitle: "Doc '), n, F.lit('"\n---\n')), part)


def _html(s, d):
    def part(x, level, i):
        level = level.cast("string")
        wrap = lambda a, z: F.concat(F.lit(a), x, F.lit(z))
        block = F.when(i % 4 == 0, wrap("<p>", " &amp;amp; <b>more</b> .</p>")).when(i % 4 == 1, wrap("<ul>\n<li>", "</li>\n</ul>")).when(i % 4 == 2, wrap("<blockquote><p>", "</p></blockquote>")).otherwise(wrap("<pre>  ", "\n\n\n    end : x</pre>"))
        return F.concat(
            F.lit("<h"), level, F.lit(">Part <i>"), i.cast("string"), F.lit("</i></h"), level, F.lit(">"), block,
            F.lit("<aside><p>no</p></aside>")
        )

    return _built(
        s, d, lambda n: F.concat(F.lit("<title>Doc "), n, F.lit("</title><body><nav><p>menu</p></nav>")), part,
        "<script>var x = 1;</script>"
    )


def markdown_sections(s, d):
    return sections.sections(_markdown(s, d), sections.MARKDOWN).withColumn("section_path", X.breadcrumb(F.col("section_path")))


def html_sections(s, d):
    return sections.sections(_html(s, d), sections.PAGE).withColumn("section_path", X.breadcrumb(F.col("section_path")))


def page_sections(s, d):
    """The sections of the pages as they are; html_sections holds the reader against pages of known sections."""
    return sections.sections(_t(s, d, "pages"), sections.PAGE, "page_id", "html").withColumn(
        "section_path", X.breadcrumb(F.col("section_path"))
    )


def _corpus(s, d):
    """A manifest of the documents written anew, a third of them not allowed, and its sections."""
    built = _markdown(s, d).join(_t(s, d, "documents").select("doc_id", "source", F.col("lang").alias("language")), "doc_id")
    path = F.concat(F.lit("content/"), "source", F.lit("/docs/d"), F.col("doc_id").cast("string"), F.lit(".md"))
    built = built.withColumn("path", F.coalesce(path, F.concat(F.lit("content/docs/d"), F.col("doc_id").cast("string"), F.lit(".md"))))
    manifest = built.select(
        F.lit("s1").alias("snapshot_id"), F.col("path").alias("source_path"), corpus.source_url_of(F.col("path")).alias("source_url"),
        corpus.doc_id_of(F.col("path")).alias("doc_id"), "language", F.lit("l").alias("license"), F.lit("a").alias("attribution"),
        F.when(F.col("doc_id") % 3 != 1, "yes").otherwise("").alias("allowed")
    )
    return corpus.parsed(manifest, built.select("path", "text"))


def corpus_artifact(s, d):
    """From the manifest to chunks."""
    rows = corpus.chunked_sections(_corpus(s, d), 40, 10)
    return rows.select(
        "doc_id", "section_id", "chunk_id", "chunk_index", "doc_title", F.array_join("section_path", " > ").alias("section_path"),
        "source_url", "language", "start_offset", "end_offset", "token_count"
    )


def corpus_registry(s, d):
    """Which documents, sections and chunks a corpus has, sections and chunks each lacking some."""
    docs = _t(s, d, "documents")
    parsed = docs.where("lang <> 'de'").select(
        F.col("source").alias("doc_id"), F.concat(F.lit(" "), "source", F.lit("-"), "lang").alias("section_id")
    )
    pieces = docs.where("lang <> 'fr'").select(
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("doc_id"),
        F.concat("source", F.lit("-"), "lang").alias("section_id"), F.substring(F.sha2("text", 256), 1, 6).alias("chunk_id")
    )
    return corpus.registry(parsed, pieces)


def _ingested(s, d):
    """Documents as a manifest, sections and chunks with defects: ids of equal texts repeat, and one language each lacks a field."""
    docs = _t(s, d, "documents")
    own = F.when(F.col("lang") != "es", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12))
    key = F.col("doc_id").cast("string").alias("doc_id")
    manifest = docs.where("lang <> 'de'").select(F.col("doc_id").alias("place"), F.lit("s1").alias("snapshot_id"), key)
    parsed = docs.select(F.col("doc_id").alias("place"), own.alias("section_id"), key, "text")
    pieces = docs.select(
        F.col("doc_id").alias("place"), own.alias("chunk_id"), key, "text", F.lit("s1").alias("snapshot_id"),
        F.lit("u").alias("source_url"), F.when(F.col("lang") != "fr", "l").alias("license"),
        F.when(F.col("lang") == "de", " ").otherwise("a").alias("attribution"),
        F.when(F.col("lang") == "en", F.array("lang")).otherwise(F.array().cast("array<string>")).alias("section_path"),
        F.lit(0).alias("start_offset"), F.when(F.col("lang") == "fr", "-1").otherwise("x").alias("end_offset"),
        F.col("n_chars").cast("string").alias("token_count")
    )
    return manifest, parsed, pieces


def ingest_errors(s, d):
    _, parsed, pieces = _ingested(s, d)
    return checks.ingest_errors(parsed, pieces).select("part", "place", "message")


def ingest_quality(s, d):
    return checks.ingest_quality(*_ingested(s, d))


def query_set_errors(s, d):
    """Labels as a query set with defects, held against the English documents as its registry."""
    rows, known = _t(s, d, "labels"), _t(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").cast("string").alias("id"))
    key, no_ids = F.array(F.col("doc_id").cast("string")), F.array().cast("array<string>")
    entries = rows.select(
        F.col("doc_id").alias("place"), F.concat(F.lit("q"), F.floor(F.col("doc_id") / 2).cast("string")).alias("query_id"),
        F.when(F.col("toxic") == 1, "b").otherwise("a").alias("snapshot_id"), (F.col("quality") == 1).alias("answerable"),
        key.alias("doc_ids"), no_ids.alias("expected_section_ids"),
        F.when(F.col("toxic") == 0, key).otherwise(no_ids).alias("expected_chunk_ids")
    )
    ids = known.select(F.lit("doc").alias("kind"), "id").union(known.select(F.lit("chunk"), "id"))
    about = {
        "snapshot_id": "a", "row_count": 0, "doc_count": 0, "section_id_count": 0, "chunk_id_count": 0,
        "default_chunking": {"max_tokens": 350}
    }
    return checks.query_set_errors(entries, about, {"snapshot_id": "c", "default_chunking": {}}, ids).select("part", "place", "message")


def response_contract(s, d):
    rows = _t(s, d, "conversations")
    record = F.array(
        F.struct(
            F.lit("[1]").alias("marker"), F.lit("d").alias("doc_id"), F.lit("c").alias("chunk_id"), F.lit(0).alias("start_offset"),
            F.col("turn").cast("int").alias("end_offset")
        )
    )
    full = rows.withColumn("final_answer", F.col("text")).withColumn(
        "citations", F.when(F.col("conv_id") % 2 == 0, record).otherwise(F.array().cast(answers.CITATIONS))
    )
    full = full.withColumn("is_refusal", F.col("role") == "user").withColumn("reason_code", F.when(F.col("turn") == 0, "no_relevant_docs")).withColumn("message", F.when(F.col("turn") < 2, F.lit("m")))
    return full.select("conv_id", "turn", F.array_join(checks.contract_breaches(full), ",").alias("breaches"))


def redacted_events(s, d):
    return tables.redacted(_t(s, d, "conversations").select("conv_id", "turn", "role", "text"))


def jsonl_documents(s, d):
    """Documents written as JSONL and read back."""
    path = fresh_path(s, "jsonl")
    docs = _t(s, d, "documents")
    tables.write_jsonl(docs, path)
    return tables.read_objects(s, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema))


def vector_lengths(s, d):
    """Lengths of vectors before and after they are normalised."""
    v = _t(s, d, "embeddings")
    norm = lambda c: F.round(F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))), 4)
    return vectors.normalised(v.withColumn("length", norm("embedding"))).select(
        "vec_id", "length", norm("embedding").alias("normalised_length")
    )


def vector_facts(s, d):
    return vectors.facts(_t(s, d, "embeddings"))


def hit_sources(s, d):
    """Hits with the fields of the document of their id, null where there is none."""
    docs = _t(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", "lang")
    return vectors.with_chunks(_cosine(s, d), docs, "vec_id", strict=False).select("query_id", "vec_id", "rank", "source", "lang")


def promoted_search(s, d):
    """The chunks nearest to the stated vectors, by SQL in a promoted runtime."""
    v = _t(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    root = fresh_path(s, "runtimes")
    rows = v.count()
    if not rows:
        return v.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", "label", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    about = {"runtime_id": "r1", "snapshot_id": "s1", "embedding_model_name": "given", "vector_dimension": vectors.dimension(v, "vector")[1], "row_count": rows}
    runtime.promote(v.select("chunk_id", "label"), v, about, root=root)
    hits = runtime.sql_search(s, _asked(s, d).select("query_id", "vector"), 10, "r1", root=root)
    return hits.select("query_id", "chunk_id", "label", F.round("raw_score", 6).alias("score"), "rank")


def run_summary(s, d):
    v = _t(s, d, "embeddings")
    asked = _asked(s, d).select(
        "query_id", (F.col("query_id") % 300 != 200).alias("answerable"), (F.col("query_id") * F.lit(1.5) - 1).alias("latency_ms"), "label"
    )
    same = evaluation.Shared(asked.where("answerable"), v, "label")
    return evaluation.run(lambda q, k: _cosine(s, d, k), asked.drop("label"), same, 5, "vec_id")[1]


def _citing_client():
    """A stand-in for a model: says the head of the first block. Every third question's first reply cannot be read, and every fourth's has no marker."""

    def ask(request: dict) -> dict:
        number, (chunk, text) = int(request["query_id"]) // 100, re.search(
            r'\[1\]\nchunk_id: (.*)\ntext:\n"""\n([^.\n]*)', request["user_prompt"]
        ).groups()
        if number % 3 == 1 and request["attempt"] == 1:
            raise ValueError("no JSON")
        said = re.sub(r"[\[\]!?]", "", text).strip() or "Found"
        record = {"marker": "[1]", "doc_id": chunk, "chunk_id": chunk, "start_offset": 0, "end_offset": max(1, len(text))}
        return {"final_answer": f"{said}." if number % 4 == 0 else f"{said} [1].", "citations": [record], "is_refusal": False}

    return ask


def generated_answers(s, d):
    """Questions through the gate, a stand-in for a model, citation checks and repair."""
    hits = _cosine(s, d, 3).withColumn("score", retrieval.unit_score(F.col("score")))
    docs = _t(s, d, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text"))
    hits = hits.join(docs, "vec_id").select(
        "query_id", F.col("vec_id").cast("string").alias("chunk_id"), "text", F.lit(0).alias("start_offset"),
        F.length("text").alias("end_offset"), "rank", "score"
    )
    asked = _asked(s, d).select("query_id", F.concat(F.lit("what is near "), F.col("query_id").cast("string")).alias("question"))
    out = generation.answered(asked, hits, generation.worker_generator(_citing_client))
    return out.select(
        "query_id", "status", "final_answer", F.coalesce(F.size("citations"), F.lit(0)).alias("n_citations"), "reason_code", "failure_code",
        "attempts"
    )


def _labelled(s, d):
    """The stated vectors as a labelled query set: those of one label are expected as chunks, or for every third question as sections."""
    asked = _asked(s, d)
    same = asked.join(_t(s, d, "embeddings").select("vec_id", "label"), "label").groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list("vec_id")), lambda x: x.cast("string")).alias("ids")
    )
    none, key = F.array().cast("array<string>"), F.col("query_id") % 300 == 0
    return asked.join(same, "query_id").select(
        "query_id", (F.col("query_id") % 300 != 200).alias("answerable"), F.lit(2.0).alias("latency_ms"),
        F.when(key, none).otherwise(F.col("ids")).alias("expected_chunk_ids"),
        F.when(key, F.col("ids")).otherwise(none).alias("expected_section_ids")
    )


def fixture_hits(s, d):
    """What a retriever that knows the answers gives."""
    return retrieval.fixture("oracle")(_labelled(s, d), 5).select(
        "query_id", "chunk_id", "section_id", F.round("score", 6).alias("score"), "rank"
    )


def run_results(s, d):
    """A run's results by query: cosine hits, whose section is their id, against the labelled set."""
    hits = _cosine(s, d, 5).select(
        "query_id", F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").cast("string").alias("section_id"), "score", "rank"
    )
    rows = evaluation.results("r", {"snapshot_id": "s1"}, ("exact", "dense"), _labelled(s, d), hits, 5)
    return rows.select(
        "run_id", "query_id", "snapshot_id", "retriever_name", "top_k", "answerable", "hit", F.round("recall", 6).alias("recall"),
        F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.array_join(F.transform("hits", lambda h: h.chunk_id), ",").alias("hits")
    )


def alternative_metrics(s, d):
    labelled = _labelled(s, d)
    wanted = labelled.select("query_id", F.explode("expected_chunk_ids").alias("chunk_id"))
    hits = _cosine(s, d).withColumn("chunk_id", F.col("vec_id").cast("string"))
    got = evaluation.alternative_summary(labelled, hits, wanted)
    return got.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


def source_urls(s, d):
    path = F.concat(
        F.lit("content/"), F.coalesce("lang", F.lit("xx")), F.lit("/docs/"), F.col("source"), F.lit("/d."), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".html")
    )
    return _t(s, d, "documents").where("source is not null").select(
        "doc_id", corpus.source_url_of(path, "https://site.example/").alias("source_url")
    )


def user_prompts(s, d):
    """Questions with the evidence blocks of their best documents."""
    hits = bm25_topk(s, d).where("rank <= 2").join(_t(s, d, "documents").select("doc_id", "text", "source", "lang"), "doc_id")
    hits = hits.select(
        "query_id", "rank", "doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.array(F.lit(" "), "lang").alias("section_path"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source_path"), "text"
    )
    return prompts.user_prompts(_t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), hits)


def matrix_rows(s, d):
    """Vectors written as raw float32 rows and read back."""
    path = fresh_path(s, "matrix")
    v = _t(s, d, "embeddings")
    _, width = tables.write_matrix(v.select(F.col("vec_id").alias("row_index"), F.col("embedding").alias("vector")), path)
    sums = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return tables.read_matrix(s, path, width, part_bytes=1 << 16).select("row_index", F.round(sums, 4).alias("total"), F.size("vector").alias("width"))


def queries() -> dict:
    fs = (
        token_count, chunks, ingest_report, manifest_allowlist, section_offsets, bm25_index, bm25_topk, rrf_topk, cosine_topk, hybrid_topk,
        gate_decisions, retrieval_metrics, canonical_hits, latency_percentiles, citation_markers, registry, duplicate_rows
    )
    fs += (
        claims, citation_validation, citation_repair, prompt_context, refusals, markdown_sections, html_sections, page_sections,
        corpus_artifact, corpus_registry, ingest_errors, ingest_quality, query_set_errors, response_contract, redacted_events
    )
    fs += (
        jsonl_documents, vector_lengths, vector_facts, hit_sources, promoted_search, run_summary, generated_answers, fixture_hits,
        run_results, alternative_metrics, source_urls, user_prompts, matrix_rows
    )
    return {f.__name__: f for f in fs}
