"""The evidence gate, refusals, and citation markers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X


@dataclass(frozen=True)
class Thresholds:
    k: int = 8
    top1: float = 0.75
    mean3: float = 0.60
    support: float = 0.55
    n_support: int = 2
    thin: int = 3
    no_hit: float = 0.20

    def __post_init__(self):
        scores = (self.top1, self.mean3, self.support, self.no_hit)
        if min(self.k, self.n_support, self.thin) <= 0 or not all(0 <= s <= 1 for s in scores) or self.no_hit > self.top1:
            raise ValueError("thresholds out of range")


UNIT = "unit_interval"


def unit_scores(hits: DataFrame, normalization: str) -> DataFrame:
    """hits, whose scores must be said to be of the unit interval, with any that is not in it an error when read."""
    if normalization != UNIT:
        raise ValueError(f"the gate takes scores of the {UNIT}, not {normalization!r}")
    wrong = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)
    return hits.withColumn(
        "score",
        F.when(wrong, F.raise_error(F.lit("a score is not of the unit interval")).cast("double")).otherwise(F.col("score").cast("double"))
    )


def as_contexts(hits: DataFrame) -> DataFrame:
    """What citations are checked against, from hits with their chunks: query_id, chunk_id, text, start_offset, end_offset.

    A blank chunk id or text is an error when read.
    """
    told = lambda c: F.when(
        X.blank(F.col(c)), F.raise_error(F.lit(f"a hit has no {c}")).cast("string")
    ).otherwise(F.col(c)).alias(c)
    return hits.select("query_id", told("chunk_id"), told("text"), "start_offset", "end_offset")


def gate(hits: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(query_id, top1, mean3, support, decision, reasons) from unit scores by rank.

    The mean folds the first three scores in rank order, so a score on a
    threshold does not depend on how rows were shuffled.
    """
    best = hits.where(F.col("rank") <= t.k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("h"))
    scores = F.transform("h", lambda x: x.score)
    head = F.slice(scores, 1, 3)
    f = best.select(
        "query_id", scores[0].alias("top1"), (F.aggregate(head, F.lit(0.0), lambda a, x: a + x) / F.size(head)).alias("mean3"),
        F.size(F.filter(scores, lambda s: s >= t.support)).cast("long").alias("support"), F.size(scores).alias("considered")
    )
    none = F.col("top1") < t.no_hit
    low = [
        F.when(F.col("top1") < t.top1, "low_top1"), F.when(F.col("mean3") < t.mean3, "low_mean3"),
        F.when(F.col("support") < t.n_support, "insufficient_support")
    ]
    thin = [F.when(F.col("support") == t.n_support, "support_floor_only"), F.when(F.col("considered") < t.thin, "sparse_context")]
    joined = lambda cs: F.concat_ws(",", *cs)
    decision = F.when(none, "no_relevant_docs").when(joined(low) != "", "insufficient_evidence").when(
        joined(thin) != "", "thin"
    ).otherwise("full")
    reasons = F.when(none, "no_hit_floor").when(joined(low) != "", joined(low)).otherwise(joined(thin))
    return f.select(
        "query_id", F.round("top1", 6).alias("top1"), F.round("mean3", 6).alias("mean3"), "support", decision.alias("decision"),
        reasons.alias("reasons")
    )


def markers(answers: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds valid and malformed citation markers, each comma-joined in order."""
    valid = X.found(F.coalesce(F.col(text_col), F.lit("")), X.MARKER)
    odd = F.filter(X.found(F.coalesce(F.col(text_col), F.lit("")), X.BRACKET), lambda m: ~m.rlike(r"^\[\d+\]$"))
    return answers.withColumn("valid_markers", F.array_join(valid, ",")).withColumn("malformed_markers", F.array_join(odd, ","))
