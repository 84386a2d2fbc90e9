"""Retrieval metrics and latency percentiles."""

from __future__ import annotations

import functools
import operator
import re
import time
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.retrieval import canonical
from evidentia.sources import tables
from evidentia.sources.tables import kept


#: Steps that a range of values is cut into at a time, and rows of a group that are few enough to be sorted.
BUCKETS, FEW = 1024, 10_000
#: Ranges that go to every task; more are joined.
RANGES_SENT = 100_000
#: Queries of a run that are timed, each by itself.
PROBES = 100


def percentiles(rows: DataFrame, value: str, wanted: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """by and, for each name of wanted, the nearest-rank percentile of a group's values; nulls and NaN do not count.

    A group's values are never gathered: they are counted in steps between their least and greatest, the step that holds the
    wanted rank is the next range, and so on until it holds few values or only one. A group of any size is one of partial counts.
    """
    keys = [f"_key{i}" for i in range(len(by))]
    held = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in wanted.items()])).alias("w")
    found = held.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).select("*", each)
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("w.q") * F.col("n")))
    state = kept(found.select(*keys, "w.name", "lo", "hi", "n", rank.alias("rank")))
    done = []
    while True:
        open_ = (F.col("lo") < F.col("hi")) & (F.col("n") > FEW)
        done.append(state.where(~open_))
        more = state.where(open_)
        n = more.count()
        if not n:
            break
        # Halves keep the width finite whatever the bounds.
        place = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS
        step = F.least(F.lit(BUCKETS - 1), F.floor(place)).alias("step")
        within = _within(held, more, keys, n).select(*keys, "name", "rank", "v", step)
        counts = within.groupBy(*keys, "name", "rank", "step").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "name").orderBy("step"))
        there = counts.withColumn("_upto", upto).where("_upto >= rank AND _upto - n < rank")
        state = kept(there.select(*keys, "name", "lo", "hi", "n", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank")))
    ends = functools.reduce(DataFrame.union, done)
    one = ends.where("lo = hi").select(*keys, "name", F.col("lo").alias("v"))
    few = ends.where("lo < hi")
    order = Window.partitionBy(*keys, "name").orderBy("v")
    sorted_ = _within(held, few, keys, few.count()).withColumn("_at", F.row_number().over(order)).where("_at = rank").select(*keys, "name", "v")
    out = one.union(sorted_).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in wanted])
    return out.withColumnsRenamed(dict(zip(keys, by)))


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows with each of the n ranges of their group that they lie in."""
    r = ranges.select(*[F.col(k).alias(f"r{k}") for k in keys], "name", "lo", "hi", "rank")
    on = [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys]
    near = F.broadcast(r) if n <= RANGES_SENT or not keys else r  # without keys there are as many ranges as percentiles
    inside = functools.reduce(operator.and_, on, F.col("v").between(F.col("lo"), F.col("hi")))
    return rows.join(near, inside).drop(*[f"r{k}" for k in keys])


def with_percentiles(
    totals: DataFrame, rows: DataFrame, value: str, wanted: dict[str, float], by: tuple[str, ...] = (), places: int | None = 6
) -> DataFrame:
    """totals, a row per group of rows (or one), with percentiles of theirs rounded to so many places, null without values."""
    found = percentiles(rows, value, wanted, by)
    shown = [(F.col(n) if places is None else F.round(n, places)).alias(n) for n in wanted]
    found = found.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(by)], *shown)
    on = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_of{i}")) for i, c in enumerate(by)], F.lit(True))
    return totals.join(found if by else F.broadcast(found), on, "left").drop(*[f"_of{i}" for i in range(len(by))])


class Shared(NamedTuple):
    """What is relevant by a key: to a query (query_id, key), all items (id, key) with an equal one. Their pairs are never made."""

    queries: DataFrame
    items: DataFrame
    key: str

    def totals(self, id_col: str) -> DataFrame:
        """(query_id, total): how many different ids are relevant to each query that has any."""
        asked, held = self._asked(), self._held(id_col)
        sizes = held.groupBy("_key").agg(F.count("*").alias("total"))
        keys = asked.groupBy("query_id").agg(F.count("*").alias("_n"), F.max("_key").alias("_key"))
        one = keys.where("_n = 1").join(sizes, "_key").select("query_id", "total")
        # An id may have several keys of a query with several, so it is counted once.
        more = asked.join(keys.where("_n > 1").select("query_id"), "query_id", "left_semi").join(held, "_key").select("query_id", id_col).distinct()
        return one.union(more.groupBy("query_id").agg(F.count("*").alias("total")))

    def among(self, hits: DataFrame, id_col: str) -> DataFrame:
        """The hits (query_id, id, ...) that are relevant."""
        told = hits.join(self._asked(), "query_id").join(self._held(id_col), [id_col, "_key"], "left_semi")
        return told.select(*hits.columns).distinct()

    def _asked(self) -> DataFrame:
        return self.queries.select("query_id", F.col(self.key).alias("_key")).where("_key IS NOT NULL").distinct()

    def _held(self, id_col: str) -> DataFrame:
        return self.items.select(id_col, F.col(self.key).alias("_key")).where("_key IS NOT NULL").distinct()


def per_query(hits: DataFrame, relevant: DataFrame | Shared, id_col: str = "doc_id") -> DataFrame:
    """(query_id, hit, recall, reciprocal_rank) for every query with relevant ids, given as pairs (query_id, id) or by a shared key."""
    shown = hits.select("query_id", id_col, "rank")
    if isinstance(relevant, Shared):
        right, total = relevant.among(shown, id_col), relevant.totals(id_col)
    else:
        wanted = relevant.select("query_id", id_col).distinct()
        right, total = shown.join(wanted, ["query_id", id_col], "left_semi"), wanted.groupBy("query_id").agg(F.count("*").alias("total"))
    found = right.groupBy("query_id").agg(F.min("rank").alias("best"), F.countDistinct(id_col).alias("n"))
    out = total.join(found, "query_id", "left")
    return out.select(
        "query_id", F.coalesce((F.col("n") > 0).cast("double"), F.lit(0.0)).alias("hit"),
        F.round(F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 6).alias("reciprocal_rank")
    )


def summary(queries: DataFrame, hits: DataFrame, relevant: DataFrame | Shared, id_col: str = "doc_id") -> DataFrame:
    """One row for a run. queries: query_id, answerable, latency_ms; means are over queries with relevant ids, 0 without any.

    Latencies below 0 count as 0, and null ones, which were not measured, for nothing; percentiles are nearest ranks.
    """
    scored = per_query(hits, relevant, id_col)
    shown = hits.select("query_id").distinct().withColumn("_shown", F.lit(True))
    rows = queries.join(scored, "query_id", "left").join(shown, "query_id", "left").withColumn("_ms", _not_below_0("latency_ms"))
    n = lambda test: F.count(F.when(test, 1))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    totals = rows.agg(
        F.count("*").alias("queries"),
        n(F.col("answerable")).alias("answerable"),
        n(~F.col("answerable")).alias("unanswerable"),
        n(F.col("hit").isNotNull()).alias("relevant"),
        n(F.col("_shown")).alias("with_results"),
        n(F.col("_shown").isNull()).alias("without_results"),
        mean("hit").alias("hit_at_k"),
        mean("recall").alias("recall_at_k"),
        mean("reciprocal_rank").alias("mrr"),
        mean("_ms").alias("average_latency_ms"),
        F.round(F.max("_ms"), 6).alias("max_latency_ms"),
    )
    return with_percentiles(totals, queries.select(_not_below_0("latency_ms").alias("_ms")), "_ms", LATENCIES)


#: The percentiles of a run's latencies.
LATENCIES = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}


def _not_below_0(value: str):
    return F.when(F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.col(value)))


def alternative_summary(queries: DataFrame, hits: DataFrame, relevant: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row of unrounded means over the answerable queries, those without relevant ids counting 0; latencies are over all.

    queries: query_id, answerable, latency_ms; means over nothing are 0.
    """
    wanted = relevant.select("query_id", id_col).distinct()
    found = hits.select("query_id", id_col, "rank").join(wanted, ["query_id", id_col], "left_semi").groupBy("query_id").agg(
        F.min("rank").alias("best"), F.countDistinct(id_col).alias("n")
    )
    total = wanted.groupBy("query_id").agg(F.count("*").alias("total"))
    rows = queries.join(total, "query_id", "left").join(found, "query_id", "left").withColumn("_ms", _not_below_0("latency_ms"))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("answerable"), c)), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("query_count"),
        F.count(F.when(F.col("answerable"), 1)).alias("answerable_query_count"),
        mean(F.coalesce((F.col("n") > 0).cast("double"), F.lit(0.0))).alias("hit_at_k"),
        mean(F.coalesce(F.col("n") / F.col("total"), F.lit(0.0))).alias("recall_at_k"),
        mean(F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"),
        F.coalesce(F.avg("_ms"), F.lit(0.0)).alias("mean_latency_ms"),
        F.coalesce(F.max("_ms"), F.lit(0.0)).alias("max_latency_ms"),
    )


def slug(text: str) -> str:
    """Lower case, with one dash for every run of other characters than letters and digits."""
    return re.sub("[^a-z0-9]+", "-", text.strip().lower()).strip("-") or "retriever"


def run_id(snapshot: str, version: str, mode: str, retriever: str, k: int) -> str:
    """The name of a run; parts that are empty are left out."""
    if k <= 0:
        raise ValueError("k must be positive")
    return "-".join(filter(None, (snapshot, version, slug(mode), slug(retriever), f"top{k}")))


def run_paths(folder: str, name: str) -> tuple[str, str]:
    """Where a run's results and its summary lie."""
    return f"{folder.rstrip('/')}/{name}.results.jsonl", f"{folder.rstrip('/')}/{name}.summary.json"


def run(retrieve, queries: DataFrame, relevant: DataFrame | Shared, k: int, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(hits, summary) of a retriever, a callable (queries, k) -> (query_id, id, score, rank) for all queries at once."""
    if k <= 0:
        raise ValueError("k must be positive")
    hits = canonical(retrieve(queries, k), k, id_col)
    return hits, summary(queries, hits, relevant, id_col)


def latencies(retrieve, queries: DataFrame, k: int, probes: int = PROBES, clock=time.perf_counter_ns) -> DataFrame:
    """(query_id, latency_ms): how long a retriever takes for a query asked alone, in a job of its own, one after the other.

    With more than `probes` queries those of the smallest hashes are asked, so a run's cost for timing does not grow with its queries.
    """
    spark = queries.sparkSession
    ids = [r[0] for r in queries.select("query_id").distinct().orderBy(F.xxhash64("query_id"), "query_id").limit(probes).collect()]
    took = []
    for i in ids:
        one, begun = queries.where(F.col("query_id").eqNullSafe(F.lit(i))), clock()
        retrieve(one, k).write.format("noop").mode("overwrite").save()
        took.append((i, max(0.0, (clock() - begun) / 1e6)))
    schema = T.StructType([queries.schema["query_id"], T.StructField("latency_ms", T.DoubleType())])
    return spark.createDataFrame(took, schema)


def _timed(retrieve, queries: DataFrame, k: int, probes: int, clock) -> DataFrame:
    asked = kept(queries.drop("latency_ms"))
    return kept(asked.join(F.broadcast(latencies(retrieve, asked, k, probes, clock)), "query_id", "left"))  # a row per probe


def timed_run(
    retrieve, queries: DataFrame, relevant: DataFrame, k: int, id_col: str = "doc_id", clock=time.perf_counter_ns, probes: int = PROBES
) -> tuple[DataFrame, DataFrame]:
    """run() with latency_ms of each probe, see latencies(); hits are of all queries at once, made once and kept."""
    asked = _timed(retrieve, queries, k, probes, clock)
    hits = kept(canonical(retrieve(asked, k), k, id_col))
    return hits, summary(asked, hits, relevant, id_col)


def relevant_ids(entries: DataFrame) -> DataFrame:
    """(query_id, kind, id): the expected chunks of a query, or its expected sections where it has no chunks."""
    chunk_ids, section_ids = (F.coalesce(c, F.array().cast("array<string>")) for c in ("expected_chunk_ids", "expected_section_ids"))
    kind = F.when(F.size(chunk_ids) > 0, "chunk_id").otherwise("section_id")
    ids = F.when(F.size(chunk_ids) > 0, chunk_ids).otherwise(section_ids)
    return entries.select("query_id", kind.alias("kind"), F.explode(F.array_distinct(ids)).alias("id"))


def results(name: str, about: dict, retriever: tuple[str, str], entries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The results of a run (tables.RESULTS), a row per query of a labelled set.

    hits: query_id, chunk_id, score, rank and, if there are, doc_id, section_id and the ranks of fused lists; entries may have latency_ms.
    """
    have = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    ranks = [c for c in hits.columns if c.endswith("_rank")]
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("int").alias("value")) for c in ranks]
    told = F.filter(F.array(*pairs), lambda p: p.value.isNotNull()) if pairs else F.array().cast("array<struct<key:string,value:int>>")
    hit = F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"),
        F.col("score").cast("double").alias("score"), have(hits, "doc_id", "string"), have(hits, "section_id", "string"),
        told.alias("metadata")
    )
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    listed = listed.withColumn(
        "hits",
        F.transform(
            "hits",
            lambda h: F.struct(
                h.chunk_id.alias("chunk_id"), h.score.alias("score"), h["rank"].alias("rank"), h.doc_id.alias("doc_id"),
                h.section_id.alias("section_id"), F.map_from_entries(h.metadata).alias("metadata")
            )
        )
    )
    wanted = relevant_ids(entries)
    by_kind = hits.select(
        "query_id", "rank",
        F.explode(
            F.array(
                F.struct(F.lit("chunk_id").alias("kind"), F.col("chunk_id").cast("string").alias("id")),
                F.struct(F.lit("section_id").alias("kind"), have(hits, "section_id", "string").alias("id"))
            )
        ).alias("x")
    ).select("query_id", "rank", "x.*")
    found = by_kind.join(wanted, ["query_id", "kind", "id"], "left_semi").groupBy("query_id").agg(
        F.min("rank").alias("best"), F.countDistinct("id").alias("n")
    )
    total = wanted.groupBy("query_id").agg(F.count("*").alias("total"))
    rows = entries.join(listed, "query_id", "left").join(found, "query_id", "left").join(total, "query_id", "left")
    snapshot, (retriever_name, kind) = about.get("snapshot_id"), retriever
    recall, rr = F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)), F.coalesce(1 / F.col("best"), F.lit(0.0))
    no_hits = F.array().cast(tables.HITS)
    return rows.select(
        F.lit(name).alias("run_id"), "query_id", F.lit(snapshot).alias("snapshot_id"), F.lit(retriever_name).alias("retriever_name"),
        F.lit(kind).alias("retriever_type"), F.lit(k).alias("top_k"), "answerable", "expected_chunk_ids",
        (F.coalesce("n", F.lit(0)) > 0).alias("hit"), recall.alias("recall"), rr.alias("reciprocal_rank"),
        have(entries, "latency_ms", "double"), F.coalesce(F.col("hits").cast(tables.HITS), no_hits).alias("hits")
    )


def baseline(retrieve, retriever: tuple[str, str], entries: DataFrame, about: dict, k: int, folder: str) -> tuple[str, str]:
    """Runs a retriever, named (name, type), over a labelled query set and writes results and summary below folder; returns their paths."""
    name = run_id(about.get("snapshot_id") or "", about.get("dataset_version") or "", retriever[1], retriever[0], k)
    asked = _timed(retrieve, entries, k, PROBES, time.perf_counter_ns)
    hits = kept(canonical(retrieve(asked, k), k, "chunk_id"))
    rows = kept(results(name, about, retriever, asked, hits, k))
    to_results, to_summary = run_paths(folder, name)
    tables.write_results(rows, to_results)
    scored = rows.select("query_id", "answerable", "latency_ms", F.size("hits").alias("_n"), "hit", "recall", "reciprocal_rank")
    of = relevant_ids(entries).select("query_id").distinct().withColumn("_labelled", F.lit(True))
    tables.write_summary(_totals(scored.join(of, "query_id", "left")), name, to_summary)
    return to_results, to_summary


def _totals(rows: DataFrame) -> DataFrame:
    count = lambda test: F.count(F.when(test, 1))
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("_labelled"), F.col(c).cast("double"))), F.lit(0.0)), 6)
    totals = rows.agg(
        F.count("*").alias("queries"), count(F.col("answerable")).alias("answerable"), count(~F.col("answerable")).alias("unanswerable"),
        count(F.col("_labelled")).alias("relevant"), count(F.col("_n") > 0).alias("with_results"),
        count(F.col("_n") == 0).alias("without_results"), mean("hit").alias("hit_at_k"), mean("recall").alias("recall_at_k"),
        mean("reciprocal_rank").alias("mrr"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("average_latency_ms"),
        F.round(F.max("latency_ms"), 6).alias("max_latency_ms"),
    )
    return with_percentiles(totals, rows, "latency_ms", LATENCIES)


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, nearest-rank percentiles and the longest of a value by group."""
    totals = rows.groupBy(*by).agg(F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("longest"))
    return with_percentiles(totals, rows, value, {"p50": 0.5, "p95": 0.95}, by, None)
