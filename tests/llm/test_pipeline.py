"""Every stage of the pipeline on small documents against brute force, and on odd input."""

import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import bpe

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BLANK = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """The smallest tables with odd rows besides, as a folder."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("length(text) > 400 and lang = 'en'").orderBy("doc_id").first()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    odd = [
        (90001, None, "en", "s", 0), (90002, "", "en", "s", 0), (90003, "12 !? 34", None, "s", 8),
        (90004, first.text, "en", "s", len(first.text)), (90005, first.text + " more", None, None, 1), (90006, first.text, "en", "s", 1),
        (90006, first.text, "en", "s", 1), (None, "the words of no id at all and of the rest", "en", "s", 3),
        (90007, f"the of and {item} in the", "en", "s", 4), (90008, "the and of in to " * 20000, "en", "s", 5)
    ]
    docs.select(*COLUMNS).union(spark.createDataFrame(odd, docs.select(*COLUMNS).schema)).withColumn("label", F.lit("extra")).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def steps(spark, data):
    """(name, rows before, rows after) of all stages."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, data).cache()
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return {name: rest for name, *rest in out}


def test_language_id_keeps_what_has_a_language(steps):
    before, after, columns = steps["language_id"]
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert columns == [*COLUMNS, "label"]
    kept = sorted(str(tuple(r)) for r in after)
    assert set(kept) <= {str(tuple(r)) for r in before if letters(r.text)}
    assert len(kept) >= 0.97 * sum(letters(r.text) for r in before)


def test_near_dedup_keeps_one_of_each_group(steps):
    before, after, _ = steps["near_dedup"]
    lowered = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)

    def shingles(t):
        w = re.findall(BLANK, lowered(t))
        return {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in before if r.doc_id is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and min(len(sets[x]), len(sets[y])) * 100 >= 80 * max(len(sets[x]), len(sets[y])) > 0:
                both = len(sets[x] & sets[y])
                if 100 * both >= 80 * len(sets[x] | sets[y]):
                    a, b = top(x), top(y)
                    up[max(a, b)] = min(a, b)
    want = sorted(str(tuple(r)) for r in before if r.doc_id is None or top(r.doc_id) == r.doc_id)
    assert sorted(str(tuple(r)) for r in after) == want and len(want) < len(before)


def test_substring_dedup_cuts_what_occurs_earlier(steps):
    before, after, _ = steps["substring_dedup"]
    seen, key = {}, lambda r, a: (r.doc_id is not None, r.doc_id or 0, a)
    words = [(r, re.findall(BLANK, r.text)) for r in before]
    for r, w in words:
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            seen[k] = min(seen.get(k, (True, 1 << 62, 0)), key(r, a))
    want = []
    for r, w in words:
        gone = {p for a in range(len(w) - 19) if seen[tuple(w[a : a + 20])] < key(r, a) for p in range(a, a + 20)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r.text
        if not gone or len(gone) < len(w):
            want.append((r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars, r.label))
    assert sorted(map(str, map(tuple, after))) == sorted(map(str, want))


def test_decontamination_drops_benchmark_passages(spark, data, steps):
    before, after, _ = steps["decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else set()
    sizes = {len(k) for k in windows}
    hit = lambda w: any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1))
    want = [r for r in before if not hit(words(r.text))]
    assert sorted(map(str, map(tuple, after))) == sorted(map(str, map(tuple, want)))
    assert 90007 in {r.doc_id for r in before} - {r.doc_id for r in after}


def test_byte_bpe_gives_the_library_s_ids(steps):
    before, after, columns = steps["byte_bpe"]
    enc = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.rank_table(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))), special_tokens={}
    )
    want = sorted((str(r.doc_id), enc.encode_ordinary(r.text)) for r in before)
    assert sorted((str(r.doc_id), list(r.ids)) for r in after) == want
    assert columns == ["doc_id", "lang", "source", "label", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_run_is_all_stages(spark, data, steps):
    got = corpus_pipeline.run(spark, data).select("doc_id", "ids_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r.doc_id, r.ids_sha256)) for r in steps["byte_bpe"][1])


def test_an_empty_table_stays_empty(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
