"""Sources, sinks, vector tables, checks and the generation loop on literal cases."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from evidentia.operators import checks, evaluation, generation, retrieval, trust, vectors
from evidentia.sources import tables

RECORD = {"marker": "[1]", "doc_id": "d", "chunk_id": "c1", "start_offset": 0, "end_offset": 5}


def test_bad_lines_have_their_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n \t\n[2]\n{"x": 3}\n{"x": \n')
    (tmp_path / "b.jsonl").write_text('\t{"x": 4}\n\t\n')
    rows = tables.bad_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.line, r.text) for r in rows] == [("a.jsonl", 3, "[2]"), ("a.jsonl", 5, '{"x": ')]
    with pytest.raises(ValueError, match="a.jsonl:3"):
        tables.read_objects(spark, str(tmp_path), "x int")
    assert tables.read_objects(spark, str(tmp_path / "b.jsonl"), "x int").first().x == 4


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = ['{"x": %d}' % i for i in range(30000)]
    lines[7], lines[29990] = "7", "x"
    path = tmp_path / "long.jsonl"
    path.write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert [r.line for r in tables.bad_lines(spark, str(path)).orderBy("line").collect()] == [8, 29991]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_matrix(spark, tmp_path):
    path = tmp_path / "v.f32"
    path.write_bytes(struct.pack("<6f", 1, 2, 3, 4, 5, 6))
    assert [
        (r.row_index, r.vector) for r in tables.read_matrix(spark, str(path), 2).orderBy("row_index").collect()
    ] == [(0, [1, 2]), (1, [3, 4]), (2, [5, 6])]
    for width in (0, 4):
        with pytest.raises(ValueError):
            tables.read_matrix(spark, str(path), width)


def test_a_matrix_file_is_read_in_ranges(spark, tmp_path):
    path = tmp_path / "v.f32"
    path.write_bytes(struct.pack("<30000f", *range(30000)))
    rows = tables.read_matrix(spark, str(path), 3, part_bytes=12 * 1500)
    assert rows.rdd.getNumPartitions() == 7  # of one file
    got = rows.orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(10000)) and all(r.vector == [3 * r.row_index + k for k in range(3)] for r in got)


def test_a_written_matrix_is_its_listed_parts(spark, tmp_path):
    rows = spark.range(5000).selectExpr("4999 - id AS row_index", "array(float(4999 - id), 0.5f) AS vector").repartition(6)
    path = str(tmp_path / "m")
    assert tables.write_matrix(rows, path) == (5000, 2)
    parts = json.loads((tmp_path / "m" / "_rows.json").read_text())
    assert len(parts) > 1 and [p["row"] for p in parts] == [sum(q["rows"] for q in parts[:k]) for k in range(len(parts))]
    raw = b"".join((tmp_path / "m" / p["name"]).read_bytes() for p in parts)
    assert raw == struct.pack("<10000f", *(x for i in range(5000) for x in (i, 0.5)))
    (tmp_path / "m" / "part-left.f32").write_bytes(b"1234")  # of a failed attempt
    assert tables.read_matrix(spark, path, 2).count() == 5000
    assert tables.write_matrix(rows.where("row_index < 10"), path) == (10, 2)
    assert sorted(r.row_index for r in tables.read_matrix(spark, path, 2).collect()) == list(range(10))
    assert not (tmp_path / "m" / "part-left.f32").exists()
    with pytest.raises(ValueError, match="no matrix"):
        tables.read_matrix(spark, str(tmp_path / "none"), 2)


def test_thresholds(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(
        "trust:\n  retrieval_sufficiency:\n    score_normalization: unit_interval\n    k: 8\n    T_top1: 0.75\n    T_mean3: 0.60\n    "
            "T_support: 0.55\n    N_support: 2\n    L_thin_max: 3\n    T_nohit: 0.20  # floor\nother:\n  k: 1\n"
    )
    assert trust.Thresholds(**tables.read_thresholds(spark, str(path))) == trust.Thresholds()
    path.write_text("retrieval_sufficiency:\n  score_normalization: rank\n")
    with pytest.raises(ValueError, match="unit scores"):
        tables.read_thresholds(spark, str(path))


def test_results_and_registry_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("r", "q", None, "n", "t", 5, True, ["c"], True, 1.0, 1.0, 0.5, [("c", 0.5, 1, None, None, {"dense": 1})])], tables.RESULTS
    )
    tables.write_results(rows, str(tmp_path / "runs"))
    assert tables.read_results(spark, str(tmp_path / "runs")).collect() == rows.collect()
    tables.write_json_object(
        spark, {"snapshot_id": "s", "doc_ids": ["d"], "section_ids": [], "chunk_ids": ["c", "e"], "default_chunking": {"max_tokens": 350}},
        tables.REGISTRY, str(tmp_path / "registry")
    )
    head, ids = tables.read_registry(spark, str(tmp_path / "registry"))
    assert head == {"snapshot_id": "s", "default_chunking": {"max_tokens": 350}}
    assert sorted(map(tuple, ids.collect())) == [("chunk", "c"), ("chunk", "e"), ("doc", "d")]


def test_defective_corpus(spark):
    manifest = spark.createDataFrame([(1, "s", "d")], "place long, snapshot_id string, doc_id string")
    sections = spark.createDataFrame([(1, "sec", "d", "text")], "place long, section_id string, doc_id string, text string")
    chunk = lambda at, **over: (
        at,
        *{
            **dict(
                source_url="u", license="l", attribution="a", snapshot_id="s", doc_id="d", chunk_id="c", section_path=["p"],
                start_offset="0", end_offset="4", token_count="2", text="t"
            ),
            **over
        }.values()
    )
    schema = "place long, " + ", ".join(f"{n} {'array<string>' if n == 'section_path' else 'string'}" for n in checks.REQUIRED)
    good = spark.createDataFrame([chunk(1), chunk(2, chunk_id="c2", token_count="3")], schema)
    assert checks.ingest_errors(sections, good).isEmpty() and checks.ingest_warnings(manifest, sections, good) == []
    row = checks.ingest_quality(manifest, sections, good).first()
    assert (
        row.document_count, row.section_count, row.chunk_count, row.estimated_token_count, row.error_count, row.snapshot_id
    ) == (1, 1, 2, 5, 0, "s")
    bad = spark.createDataFrame(
        [
            chunk(1), chunk(2, text=" \n", license=" "), chunk(3, chunk_id=None, token_count=None, section_path=[], start_offset="9"),
            chunk(4, chunk_id="z", doc_id="other", end_offset="many")
        ],
        schema
    )
    got = [r.message for r in checks.ingest_errors(sections, bad).orderBy("part", "place", "step").collect()]
    assert got == [
        "Empty chunk text: c", "Duplicate chunk_id: c", "Missing required metadata 'license' on chunk c",
        "Missing required metadata 'text' on chunk c", "Missing required metadata 'chunk_id' on chunk <missing-chunk-id-3>",
        "Missing required metadata 'section_path' on chunk <missing-chunk-id-3>",
        "Missing required metadata 'token_count' on chunk <missing-chunk-id-3>", "Invalid chunk offsets: <missing-chunk-id-3>"
    ]
    assert checks.ingest_quality(manifest, sections, bad).first().error_count == len(got)
    assert checks.ingest_warnings(manifest, sections, bad) == [checks.WARNINGS["chunk_docs"]]
    nothing = checks.ingest_quality(*(df.limit(0) for df in (manifest, sections, good))).first()
    assert (nothing.document_count, nothing.error_count, nothing.snapshot_id) == (0, 0, None)
    with pytest.raises(ValueError, match="8 findings"):
        checks.require_none(checks.ingest_errors(sections, bad))


def test_sound_query_set(spark):
    entries = spark.createDataFrame(
        [(1, "q1", "s", True, ["d"], [], ["c"]), (2, "q2", "s", False, [], [], None)],
        "place long, query_id string, snapshot_id string, answerable boolean, doc_ids array<string>, expected_section_ids array<string>, "
            "expected_chunk_ids array<string>"
    )
    ids = spark.createDataFrame([("doc", "d"), ("chunk", "c")], "kind string, id string")
    about = {"snapshot_id": "s", "row_count": 2, "doc_count": 1, "section_id_count": 0, "chunk_id_count": 1, "default_chunking": {"k": 1}}
    checks.require_none(checks.query_set_errors(entries, about, {"snapshot_id": "s", "default_chunking": {"k": 1}}, ids))
    found = checks.query_set_errors(
        entries.limit(0), about, {"snapshot_id": "s", "default_chunking": {"k": 1}}, ids
    ).orderBy("part").collect()
    assert [r.message for r in found] == ["Dataset must contain at least one entry.", "Metadata row_count=2 does not match dataset size=0"]


def test_run_summary(spark):
    asked = spark.createDataFrame(
        [("q1", True, 1.0), ("q2", True, 2.0), ("q3", False, 1.0)], "query_id string, answerable boolean, latency_ms double"
    )
    hits = spark.createDataFrame(
        [("q1", "b", 1, 0.9), ("q1", "noise", 2, 0.8), ("q2", "noise", 1, 0.9), ("q2", "c", 2, 0.8)],
        "query_id string, doc_id string, rank long, score double"
    )
    gold = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c")], "query_id string, doc_id string")
    row = evaluation.run(lambda q, k: hits, asked, gold, 5)[1].first()
    assert (
        row.hit_at_k, row.recall_at_k, row.mrr, row.average_latency_ms, row.p50_latency_ms, row.p95_latency_ms, row.max_latency_ms
    ) == (1.0, 0.75, 0.75, 1.333333, 1.0, 2.0, 2.0)
    assert (row.queries, row.answerable, row.relevant, row.with_results) == (3, 2, 2, 2)
    assert evaluation.run_id("snap-1", "v1", "dense", "dense-exact", 5) == "snap-1-v1-dense-dense-exact-top5"


def test_index_and_joins(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, "alpha", [1.0, 0.0, 0.0]), (1, "beta", [0.8, 0.2, 0.0]), (2, "gamma", [0.0, 1.0, 0.0])],
        "row_index long, chunk_id string, vector array<float>"
    )
    vectors.write_index(rows, str(tmp_path / "index"), "m", "s")
    index = vectors.read_index(spark, str(tmp_path / "index"))
    hits = retrieval.cosine(
        index, spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<float>"), 3, "chunk_id", "vector"
    ).withColumnRenamed("vec_id", "chunk_id")
    assert [r.chunk_id for r in hits.orderBy("rank").collect()] == ["alpha", "beta", "gamma"]
    chunks = spark.createDataFrame([(0, "alpha", "A"), (1, "beta", "B")], "row_index long, chunk_id string, text string")
    assert {
        r.chunk_id: r.text for r in vectors.with_chunks(hits, chunks, strict=False).collect()
    } == {"alpha": "A", "beta": "B", "gamma": None}
    with pytest.raises(Exception, match="no chunk for chunk_id gamma"):
        vectors.with_chunks(hits, chunks).collect()
    with pytest.raises(Exception, match="no chunk for row_index 0"):
        vectors.with_chunks(rows.limit(1), chunks.withColumn("chunk_id", F.lit("x")), "row_index").collect()
    with pytest.raises(ValueError, match="2 chunks and 3 vectors"):
        vectors.paired(chunks, rows)
    assert vectors.normalised(
        spark.createDataFrame([([0.0, 0.0],), (None,), ([3.0, 4.0],)], "embedding array<float>")
    ).collect()[0].embedding == [0, 0]
    for bad in ([], [([1.0],), ([1.0, 2.0],)], [([],)]):
        with pytest.raises(ValueError):
            vectors.dimension(spark.createDataFrame(bad, "embedding array<float>"))


def test_embedders(spark):
    texts = spark.createDataFrame([("ab",), (None,), ("abc",)], "text string")
    got = vectors.embedded(texts, lambda: lambda some: [[len(t), 1] for t in some], batch=2).collect()
    assert [r.embedding for r in got] == [[2, 1], [0, 1], [3, 1]]
    known = spark.createDataFrame([("ab", [1.0])], "text string, vector array<float>")
    assert vectors.looked_up(texts.where("text = 'ab'"), known).first().embedding == [1.0]
    with pytest.raises(Exception, match="no vector for text: abc"):
        vectors.looked_up(texts.where("text = 'abc'"), known).collect()


def test_generation_loop(spark):
    def client():
        def ask(request):
            kind, n = request["question"], request["attempt"]
            if kind == "unreadable" or kind == "second try" and n == 1:
                raise ValueError
            if kind == "down":
                raise ConnectionError
            text = {"uncited": "Pods share resources.", "wrong": "Pods run [99]."}.get(kind, "Pods run [1].")
            return {"final_answer": text, "citations": [RECORD], "is_refusal": False}

        return ask

    kinds = ["supported", "uncited", "wrong", "unreadable", "second try", "down", "weak", "no hits"]
    asked = spark.createDataFrame([(k, k) for k in kinds], "query_id string, question string")
    hits = [(k, c, "some text", 0, 9, n, s) for k in kinds[:6] for n, (c, s) in enumerate([("c1", 0.9), ("c2", 0.8), ("c3", 0.7)], 1)]
    hits = spark.createDataFrame(
        [*hits, ("weak", "c1", "some text", 0, 9, 1, 0.9)],
        "query_id string, chunk_id string, text string, start_offset int, end_offset int, rank long, score double"
    )
    got = {r.query_id: r for r in generation.answered(asked, hits, generation.worker_generator(client)).collect()}
    assert {k: (r.status, r.reason_code or r.failure_code, r.attempts) for k, r in got.items()} == {
        "supported": ("answer", None, 1),
        "uncited": ("answer", None, 1),
        "wrong": ("refusal", "citation_validation_failed", 2),
        "unreadable": ("refusal", "citation_validation_failed", 2),
        "second try": ("answer", None, 2),
        "down": ("error", "transport_error", 1),
        "weak": ("refusal", "insufficient_evidence", 0),
        "no hits": ("refusal", "no_relevant_docs", 0),
    }
    assert got["uncited"].final_answer == "Pods share resources [1]." and got["weak"].final_answer and got["wrong"].citations is None


def test_canned_answers_ignore_case(spark):
    known = spark.createDataFrame([("What  is a Pod?", "A group [1].", False)], "question string, final_answer string, is_refusal boolean")
    asked = spark.createDataFrame([("1", " what is a pod? "), ("2", "else")], "query_id string, question string")
    rows = generation.canned_generator(known)(asked).orderBy("query_id").collect()
    assert [(r.final_answer, r.failure_code) for r in rows] == [("A group [1].", None), (None, "backend_error")]
