"""The filter audit against a plain count over all orders, and its odd inputs."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from evidentia.llm import audit

WORDS = " ".join(f"word{i}" for i in range(60))


def fails(rows):
    """(part, failing filters, id) of rows (id, text, source)."""
    out = []
    for i, text, source in rows:
        t, bad = text or "", set()
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad |= {"A"} if len(w) < 50 else set()
        bad |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        bad |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        out.append((source or "", bad, i))
    return out


def brute(rows, good, toxic):
    marked, out = fails(rows), set()
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for part in {p for p, _, _ in marked}:
        mine, removed = [(bad, i) for p, bad, i in marked if p == part], {}
        for order in orders:
            left = mine
            for f in order:
                removed[order, f] = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
        for order in orders:
            gone = 0
            for step, f in enumerate(order, 1):
                mine_now = removed[order, f]
                gone += len(mine_now)
                out.add((
                    part, order, step, len(mine) - gone, len(mine_now), sum(f in b for b, _ in mine) - len(mine_now),
                    sum(b == {f} for b, _ in mine), sum(i in good for _, i in mine_now), sum(i in toxic for _, i in mine_now),
                    sum(len(removed[o, f]) for o in orders)
                ))
    return out


ROWS = [
    (1, WORDS, "a"), (2, WORDS, "b"), (3, WORDS + " #", "a"), (4, "few words", "a"), (5, None, "a"), (6, "", "b"), (7, WORDS.upper(), "a"),
    (8, "same " * 80, "b"), (9, "SAME & " * 80, None), (9, "SAME & " * 80, None), (10, "SAME & " * 80, ""), (None, WORDS, "a"),
    (None, None, None), (11, "é " * 70 + WORDS, "c"), (12, WORDS, "a"), (0, "x " * 49 + "É", "c")
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (9, 1, 1), (12, 1, None), (4, None, 1), (None, 1, 1), (77, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def test_all_orders_against_plain_counts(spark, labels):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns(
        {c: F.lit("clash") for c in ("part", "A", "words", "digest", "state", "good", "id")}
    ).repartition(4)
    got = {tuple(r) for r in audit.audit(docs, labels).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    ).collect()}
    assert got == brute(ROWS, {1, 2, 3, 9, 12}, {2, 3, 4, 9}) and len(got) == 4 * 600


def test_states_are_shared_and_their_counts_agree(spark, labels):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    rows = audit.verdicts(docs, labels)
    found = {(r.state, r.part): r for r in audit.states(rows).collect()}
    assert {s for s, _ in found} <= set(range(32)) and len({s for s, _ in found}) == 32
    for (state, part), r in found.items():
        for i in range(5):
            if not state >> i & 1:  # an edge's removals are what its lower end lacks
                below = found.get((state | 1 << i, part))
                assert r.n - r.removed[i] == (below.n if below else 0)


def test_no_documents_and_no_labels(spark, labels):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert audit.audit(docs.limit(0), labels).count() == 0
    none = audit.audit(docs, labels.limit(0))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0) and none.count() == 2400


def test_one_text_and_one_source_may_hold_most_rows(spark, labels):
    rows = [(i, WORDS if i % 3 else f"{WORDS} {i}", "hot" if i % 4 else "other") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    first = audit.audit(docs, labels).where("filter_order = 'EABCD' AND step = 1").collect()
    want = {p: sum(1 for i, t, s in rows if s == p and t == WORDS and i != 1) for p in ("hot", "other")}
    assert {r.part: r.removed for r in first} == want
