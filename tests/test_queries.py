import duckdb
import numpy as np
import pytest

from evidentia import queries as Q
from evidentia.operators import corpus, retrieval, trust

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = Q.queries()[name](spark, SF)
    c = db.execute(Q.oracle_sql()[name])
    names = [x[0] for x in c.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: str(r)
    assert sorted(_rows(got.columns, [tuple(map(_plain, r)) for r in got.collect()]), key=key) == sorted(
        _rows(names, [tuple(map(_plain, r)) for r in c.fetchall()]), key=key
    )


def _plain(v):
    return -1e18 if v is None else v


def test_chunk_windows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = corpus.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), most=4, overlap=2).orderBy("chunk_index").collect()
    assert [r.text for r in rows] == ["one two three four", "three four five six", "five six seven eight", "seven eight nine ten"]


def test_cosine_compares_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(retrieval, "AT_ONCE", 3)
    x = np.random.default_rng(2).standard_normal((60, 4)).round(1)
    x[20:40] = x[0]
    rows = [*enumerate(x.tolist()), (60, None), (61, [0.0] * 4), (62, [1.0, None, 1.0, 1.0]), (63, [1.0, 2.0]), (64, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.cosine(df, df.selectExpr("vec_id AS query_id", "embedding AS vector"), 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    def cosine(a, b):
        if a is None or b is None or None in a or None in b or len(a) != len(b):
            return 0.0
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / size), 6) + 0.0 if size else 0.0

    want = set()
    for q, w in rows:
        best = sorted((-cosine(v, w), i) for i, v in rows)[:4]
        want |= {(q, i, -c + 0.0, n + 1) for n, (c, i) in enumerate(best)}
    assert {tuple(r) for r in got.select("query_id", "vec_id", "score", "rank").collect()} == want


def test_fusion_breaks_ties_by_id(spark):
    hits = lambda *ids: spark.createDataFrame(
        [("q", i, k + 1) for k, i in enumerate(ids)], "query_id string, doc_id string, rank long"
    )
    rows = retrieval.fused(hits("noise", "service"), hits("service", "noise"), rrf_k=10).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == ["noise", "service"]


@pytest.mark.parametrize(
    "scores,decision,reasons",
    [
        ((0.94, 0.82, 0.76, 0.40), "full", ""), ((0.75, 0.60, 0.45), "thin", "support_floor_only"),
        ((0.90, 0.70), "thin", "support_floor_only,sparse_context"), ((0.19, 0.10), "no_relevant_docs", "no_hit_floor"),
        ((0.82, 0.44, 0.41), "insufficient_evidence", "low_mean3,insufficient_support")
    ]
)
def test_gate(spark, scores, decision, reasons):
    hits = spark.createDataFrame([("q", k + 1, s) for k, s in enumerate(scores)], "query_id string, rank long, score double")
    row = trust.gate(hits).first()
    assert (row.decision, row.reasons) == (decision, reasons)
