"""Rule counts against brute force, trees against their definition, thresholds and verdicts."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import rules


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, again, windows, covered = set(), 0, {}, set()
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    for a in range(len(w) - 7):
        windows.setdefault(tuple(w[a : a + 8]), []).append(a)
    for places in windows.values():
        if len(places) > 1:
            covered |= {p for a in places for p in range(a, a + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered)


ODD = [
    None, "", "a " * 9, "a " * 8, "\n\n", "x\nx\nx ", "x\n", "é é\né é", "a b c d e f g h " * 3, " \n \n", "#*$%&|<> # é",
    "one\r\none\r\n", "  \x1c\x85", "w " * 200_000, "\n".join(["line of words here"] * 5000)
]


def test_counts_against_brute_force():
    r = random.Random(3)
    texts = ODD + ["".join(r.choice(["a ", "b ", "c\n", "d #", "ü\t", "e f g h i j k l m "]) for _ in range(r.randrange(120))) for _ in range(300)]
    got = rules.counts(pa.array(texts))
    assert list(zip(*[got[c].tolist() for c in rules.COUNTS])) == [brute(t) for t in texts]


def test_paths_and_gains_follow_the_splits():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (200, 4)), [[9, 0, 0, 0]]])
    t = rules.Tree(x, 5)

    def walk(row):
        node, depth, mine, gain = 0, 0, np.arange(len(x)), [0.0] * 4
        while t.column[node] >= 0:
            c, before = t.column[node], len(mine)
            right = row[c] > t.value[node]
            mine = mine[(x[mine, c] > t.value[node]) == right]
            gain[c] += math.log2(before / max(len(mine), 0.5))
            node, depth = t.child[node] + int(right), depth + 1
        return depth + float(rules.expected_path(len(mine))), gain

    paths, gains = t.paths(x)
    for k, row in enumerate(x):
        path, gain = walk(row)
        assert path == pytest.approx(paths[k]) and gain == pytest.approx(gains[k].tolist())
    score, cause = rules.anomaly([rules.Tree(x, s) for s in range(60)], x, len(x))
    assert cause[200] == 0 and score[200] > np.quantile(score, 0.97) and score[200] > 0.55 > np.median(score)


def test_expected_path_is_the_harmonic_formula():
    for n in (3, 10, 256):
        harmonic = sum(1 / i for i in range(1, n))
        assert float(rules.expected_path(n)) == pytest.approx(2 * harmonic - 2 * (n - 1) / n, abs=0.05)
    assert rules.expected_path([0, 1, 2]).tolist() == [0, 0, 1]


def test_thresholds_keep_clean_rows():
    n = len(rules.RATES)
    bins = [(0, 3000, 0, 50), (0, 2000, 5, 40), (0, 1000, 900, 5), (1, 3500, 60, 1), (1, 3600, 0, 1)]
    cuts = rules.thresholds(bins, 0.05)
    assert cuts == [2000 / rules.BINS, 3600 / rules.BINS] + [math.inf] * (n - 2)
    assert rules.thresholds([(0, 5, 9, 0)]) == [math.inf] * n == rules.thresholds([])


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    rows = [(i, " ".join(word() + ("##$" if i % 9 == 0 and r.random() < 0.5 else "") for _ in range(r.randrange(25, 90)))) for i in range(900)]
    labels = [(i, int(i % 9 != 0), 0) for i in range(0, 900, 2)]
    rows += [(2000, None), (2001, ""), (None, rows[1][1]), (3, rows[3][1]), (3, rows[3][1]), (2002, "a b c d e f g h " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("id", "key", "n_words", "score", "y", "kept", "symbols")}
    ).repartition(5)
    labels = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels.withColumn("text", F.lit("clash"))


def test_verdicts(spark, table):
    rows, docs, labels = table
    got = rules.judged(docs, labels).collect()
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    assert sorted((str(r.doc_id), *[r[c] for c in rules.COUNTS]) for r in got) == sorted((str(i), *brute(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    own = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    bad = [r for r in own if r.doc_id % 9 == 0]
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
    assert sum(not r.kept for r in own if r.doc_id % 9) <= 0.02 * len(own)
    assert {r.kept for r in got if r.doc_id in (2000, 2001, 2002)} == {False}
    held = [r for r in own if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100
    again = {(r.doc_id, r.score, r.kept) for r in rules.judged(docs.repartition(3), labels).collect()}
    assert again == {(r.doc_id, r.score, r.kept) for r in got}


def test_labels_of_one_kind_and_empty_tables(spark, table):
    _, docs, labels = table
    kept = rules.judged(docs, labels.where("quality = 1"))
    assert kept.where("kept = base_failed").count() == 0
    assert rules.judged(docs.limit(0), labels).count() == 0
    assert rules.judged(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_every_tree_has_about_its_rows(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("key"), *[(F.rand(3) * 5).alias(c) for c in rules.RATES])
    share = int(rules.PSI / 20000 * (1 << 32))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda t: F.pmod(F.xxhash64("key", t), F.lit(1 << 32)) < share)
    sizes = [r["count"] for r in rows.select(F.explode(drawn).alias("t")).groupBy("t").count().collect()]
    assert len(sizes) == 10 and all(180 < n < 340 for n in sizes)
    forest = rules.grown(rows, 20000, trees=10)
    assert len(forest) == 10 and all(len(t.column) <= 2 * 340 for t in forest)
