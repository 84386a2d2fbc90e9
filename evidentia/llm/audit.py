"""How filters interact: what each removes at every place of every order.

The orders of the filters form a trie; a node's survivors depend only on which filters stand above it, not on their
order, so orders share them: of n! orders' nodes 2**n states are left. They are visited depth first. A state's
survivors are its parent's without those that its last filter removes, persisted while its own branches are worked
on, and one job counts, by part, the survivors and what each filter that is left removes of them: all edges
that leave the state. The counts of a state are a table in the shared folder, with a row per part, so neither
documents nor parts pass the driver.

Texts are read once, into a table of every document's part, failures and marks; survivors are rows of it. Persisted
rows that are lost with an executor are computed again from that table. Equal texts are found by their SHA-256.

Defined results: null texts count as empty, null parts as the empty string. A document fails `identical` where a row of
smaller id has its text; null ids are smaller than nothing and nothing is smaller than they; repeated rows
do not remove each other. A mark is set where any label row of the id sets it; null ids have none. Extra
columns are not read. No documents give no rows.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.storage import drop, fresh_path, written

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
FILTERS = "ABCDE"


def failures(text: Column) -> dict[str, Column]:
    """Filters A to D of one document's text (not null): true where it fails."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "words": words,
        "A": n < FEWEST_WORDS,
        "B": 100 * distinct < DISTINCT_PERCENT * n,
        "C": 100 * capitals > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every row of docs, as a table: the booleans A to E are true where the filter fails it.

    Only digests and flags are shuffled. Of the digests those of several rows are a table of their own, so the join
    that tells later rows from the first can be split where one text has very many.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    )
    rules = failures(F.col("text"))
    rows = rows.withColumn("words", F.explode(F.array(rules.pop("words"))))  # an explode keeps the split from being computed twice
    facts = written(rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(n) for n, c in rules.items()]), "facts")
    several = facts.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    firsts = written(several.where("first < last").select("digest", "first"), "firsts")
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")
    )
    marks = written(marks, "marks")
    late = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E")
    out = facts.join(firsts, "digest", "left").join(marks, "id", "left").select(
        "part", *rules, late, *[F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")]
    )
    out = written(out, "verdicts")
    for table in (facts, firsts, marks):
        drop(table)
    return out


def states(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(state, part, n, removed, good, toxic): the survivors of each set of filters, and what every filter that is left removes of them.

    rows: part, a boolean by each filter's name that is true where it fails, good and toxic. state has bit i
    for the filter i of `filters`; removed, good and toxic are arrays by filter, 0 where it was applied already.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, "states")
    done: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        done.add(state)
        if state:
            survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [i for i in range(len(filters)) if not state >> i & 1]
        # Of a filter that was applied there is nothing left to count; leaving it in gives all states the same code.
        count = lambda mark: F.array(*[F.count_if(F.col(f) & mark) for f in filters])
        edges = survivors.groupBy("part").agg(
            F.count("*").alias("n"), count(F.lit(True)).alias("removed"), count(F.col("good")).alias("good"),
            count(F.col("toxic")).alias("toxic")
        )
        edges.select(F.lit(state).alias("state"), "*").write.mode("append").parquet(path)
        for i in left:
            if state | 1 << i not in done:
                visit(state | 1 << i, survivors.where(~F.col(filters[i])))
        if state:
            survivors.unpersist()

    visit(0, rows)
    return spark.read.parquet(path)


def orders(filters: str = FILTERS) -> list[dict]:
    """Every step of every order, n! * n of them: filter_order, step, the state before and f, the filter's number."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        state = 0
        for step, i in enumerate(order, 1):
            out.append({"filter_order": "".join(filters[j] for j in order), "step": step, "state": state, "f": i})
            state |= 1 << i
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of FILTERS.

    labels: the id, quality and toxic, which are 1 for good and for toxic documents.
    """
    n = len(FILTERS)
    rows = verdicts(docs, labels, id_col, text_col, part_col)
    counts = states(rows, FILTERS)
    drop(rows)
    every = (1 << n) - 1
    # All states of a part in one row: 2**n * (1 + 3 n) numbers, whatever the part's size.
    entry = F.map_from_entries(F.collect_list(F.struct("state", F.struct("n", "removed", "good", "toxic"))))
    parts = counts.groupBy("part").agg(entry.alias("by_state"))
    steps = F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order:string,step:int,state:int,f:int>>")  # n! * n
    at = lambda state, field: F.coalesce(F.col("by_state")[state][field], F.lit(0) if field == "n" else F.array_repeat(F.lit(0).cast("long"), n))
    gone = at(F.col("state"), "removed")[F.col("f")]
    alone = lambda i: at(F.lit(every ^ 1 << i), "removed")[i]
    ways = lambda s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())
    worth = lambda i: sum((at(F.lit(s), "removed")[i] * ways(s) for s in range(every + 1) if not s >> i & 1), F.lit(0))
    parts = parts.withColumns(
        {"alone": F.array(*[alone(i) for i in range(n)]), "worth": F.array(*[worth(i) for i in range(n)])}
    )
    return parts.select("*", F.inline(steps)).select(
        "part", "filter_order", "step",
        at(F.col("state").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("f"))), "n").cast("long").alias("kept"),
        gone.alias("removed"),
        (at(F.lit(0), "removed")[F.col("f")] - gone).alias("redundant"),
        F.col("alone")[F.col("f")].alias("unique_fails"),
        at(F.col("state"), "good")[F.col("f")].alias("good_lost"),
        at(F.col("state"), "toxic")[F.col("f")].alias("toxic_lost"),
        F.col("worth")[F.col("f")].cast("long").alias("shapley")
    )
