"""Percentiles by ranges against sorted values, and latencies of single queries."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from evidentia.operators import evaluation


@pytest.mark.parametrize("buckets, few", [(1024, 10_000), (4, 3)])
def test_percentiles_against_sorted_values(spark, monkeypatch, buckets, few):
    monkeypatch.setattr(evaluation, "BUCKETS", buckets)
    monkeypatch.setattr(evaluation, "FEW", few)
    r = random.Random(6)
    groups = {
        "ties": [1.0] * 700 + [2.0] * 5 + [1.5] * 300, "spread": [r.random() * 10 ** r.randrange(-9, 9) for _ in range(900)],
        "one": [7.5], "far": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0], "signs": [r.gauss(0, 1) for _ in range(400)], None: [3.0, 1.0, 2.0]
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("none", math.nan), ("ties", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, v double").repartition(5)
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {x.kind: [x[n] for n in wanted] for x in evaluation.percentiles(df, "v", wanted, ("kind",)).collect()}
    nearest = lambda vs, q: sorted(vs)[max(1, math.ceil(q * len(vs))) - 1]
    assert got == {k: [nearest(vs, q) for q in wanted.values()] for k, vs in groups.items()}
    everything = [v for vs in groups.values() for v in vs]
    assert [*evaluation.percentiles(df, "v", wanted).first()] == [nearest(everything, q) for q in wanted.values()]
    assert evaluation.latency(df, "v", "kind").where("kind = 'none'").first().p50 is None


def test_a_slow_query_shows_in_the_percentiles(spark):
    queries = spark.createDataFrame([(i, True) for i in range(8)], "query_id long, answerable boolean")
    relevant = spark.createDataFrame([(i, 1) for i in range(8)], "query_id long, doc_id long")

    def retrieve(asked, k):
        slow = F.udf(lambda i: time.sleep(3.0 if i == 5 else 0.0) or 1, "long")
        return asked.select("query_id", slow("query_id").alias("doc_id"), F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("rank"))

    hits, total = evaluation.timed_run(retrieve, queries, relevant, 1)
    row = total.first()
    assert row.queries == 8 and row.hit_at_k == 1.0 and hits.count() == 8
    assert row.p50_latency_ms < 2000 < 3000 <= row.p95_latency_ms == row.max_latency_ms
    few = evaluation.latencies(retrieve, queries, 1, probes=3).collect()
    assert len(few) == 3 and all(r.latency_ms > 0 for r in few)
    _, part = evaluation.timed_run(retrieve, queries.where("query_id <> 5"), relevant, 1, probes=2)
    assert part.first().max_latency_ms < 3000 and part.first().queries == 7


def test_relevance_by_a_shared_key_equals_its_pairs(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z"), (5, "a"), (5, "b")], "query_id long, label string")
    items = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (2, "b"), (3, "b"), (4, None)], "vec_id long, label string")
    hits = spark.createDataFrame(
        [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 4, 1), (5, 2, 2), (5, 4, 1)], "query_id long, vec_id long, rank long"
    )
    shared, pairs = evaluation.Shared(asked, items, "label"), asked.join(items, "label").select("query_id", "vec_id")
    got, want = evaluation.per_query(hits, shared, "vec_id"), evaluation.per_query(hits, pairs, "vec_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 1.0, 0.5, 1.0), (2, 1.0, 0.5, 0.5), (5, 1.0, 0.333333, 0.5)]
