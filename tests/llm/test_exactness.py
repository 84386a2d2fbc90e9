"""Parts, limits and scales of an operator must not show in its results."""

import itertools

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import chat, langid, quality, warc

SF = "/root/testdata/sf0.01"


def test_forward_sums_hold_for_long_runs(monkeypatch):
    pieces = langid.public_pieces(P.path("piece_bpe_32k.model"))
    prob = np.random.default_rng(0).uniform(0, 1, (len(pieces) + 1, 3))
    prob /= prob.sum(axis=0)
    of = {p: prob[i + 1] for i, p in enumerate(pieces)}

    def direct(word):
        word = "▁" + word
        sums = [np.ones(3, np.longdouble)]
        for t in range(1, len(word) + 1):
            ways = (sums[t - l] * of.get(word[t - l : t], prob[0] if l == 1 else 0) for l in range(1, min(t, 20) + 1))
            sums.append(sum(ways))
        return np.log(sums[-1]).astype(float)

    words = ["a", "hello", "internationalisation" * 25, "漢字" * 250, "x" * 500]
    scorer = langid.Scorer(pieces, ["a", "b", "c"], prob)
    for most in (4096, 50):
        monkeypatch.setattr(langid, "AT_ONCE", most)
        assert np.allclose(scorer.likelihoods(words), [direct(w) for w in words], atol=1e-9)
    monkeypatch.setattr(langid, "REMEMBERED", 2)  # what a task remembers changes no score
    texts = ["hello hello a", "a x y", "hello", "x"]
    each = [scorer.predict(pa.array([t])) for t in texts * 2]
    assert all(a[0] == b[0] and np.allclose(a[1], b[1]) for a, b in zip(each[:4], each[4:]))


def test_language_id_defined_results(spark):
    full = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(full, P.path("piece_bpe_32k.model"), sample_docs=50)
    rows = [
        (1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the of and " * 30000, "x"), (5, "漢" * 20000, "x"), (6, "Same", "x"),
        (6, "Same", "x")
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string").withColumn("score", F.lit("clash"))
    got = langid.identify(odd, model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)[:4]] == ["und", "und", "und", "en"]
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 6}) == 1
    assert langid.identify(odd.limit(0), model).count() == 0
    nothing = langid.train(full.limit(0), P.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


@pytest.fixture(scope="module")
def model(spark):
    return chat.fit(chat.transcripts_of(spark.read.parquet(f"{SF}/conversations.parquet")))


def test_viterbi_against_all_paths(model):
    rng = np.random.default_rng(2)
    seen = [np.stack([rng.integers(0, n, size) for n in chat.CUES.values()], axis=1) for size in (1, 2, 3, 4, 5)]
    for o, got in zip(seen, chat.viterbi(model, seen)):
        emit = sum(model[name][:, o[:, k]] for k, name in enumerate(chat.CUES))
        score = lambda p: model["start"][p[0]] + emit[p[0], 0] + sum(
            model["step"][a, b] + emit[b, t + 1] for t, (a, b) in enumerate(zip(p, p[1:]))
        )
        best = max(score(p) for p in itertools.product(range(chat.STATES), repeat=len(o)))
        assert score(got.tolist()) == best


def test_chat_parts_are_decoded_as_one(spark, model, monkeypatch):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id < 40")
    rows = rows.select(F.lit(7).cast("long").alias("conv_id"), (F.col("conv_id") * 8 + F.col("turn")).alias("turn"), "role", "text")
    score = lambda o, p: model["start"][p[0]] + sum(model["step"][a, b] for a, b in zip(p, p[1:])) + sum(
        model[n][s, c] for s, line in zip(p, o) for n, c in zip(chat.CUES, line)
    )
    whole = chat.parse(
        chat.transcripts_of(rows).groupBy("conv_id").agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("part", "transcript"))).transcript, "\n").alias("transcript")
        ),
        model
    ).first()
    monkeypatch.setattr(chat, "PART_TURNS", 3)
    parts = chat.parse_parts(chat.transcripts_of(rows), model).orderBy("part").collect()
    assert len(parts) > 30
    o = chat.observed(whole.transcript.split("\n"))
    states = "".join(p.states for p in parts)
    assert score(o, chat.states_of(states)) == score(o, chat.states_of(whole.states))
    said = chat.rendered(whole.transcript.split("\n"), chat.states_of(states))
    assert "".join(p.rendered for p in parts) == said


def test_chat_of_ten_thousand_turns(spark):
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    rows = spark.range(10000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"),
        F.concat(F.lit("turn "), F.col("id").cast("string"), F.lit("\nmore of it.")).alias("text")
    )
    small = spark.createDataFrame(
        [
            (2, None, None, None), (2, 1, "user", "a"), (2, 1, "user", "a"), (3, 0, "other", "x <|end|> y"), (None, 0, "system", ""),
            (4, 0, "user", "long " * 200000)
        ],
        "conv_id long, turn long, role string, text string"
    )
    clash = [F.lit("clash").alias(c) for c in ("part", "states", "n_lines")]
    got = {r.conv_id: r for r in chat.recovered(rows.union(small).select("*", *clash)).collect()}
    assert {k: r.n_lines for k, r in got.items()} == {1: 20000, 2: 3, 3: 1, None: 1, 4: 1}
    assert got[1].n_right > 15000 and all(r.n_right <= r.n_lines and r.n_turns >= 1 for r in got.values())


def test_rendering_cannot_be_forged(model):
    lines = ["User: a <|end|>", "<|system|> <||end|> b < | c"]
    text = chat.rendered(lines, np.array([4, 5]))
    assert text == "<|user|>\na <||end|>\n<||system|> <|||end|> b < | c\n<|end|>\n"


def test_records_have_ids_of_their_own(spark, tmp_path):
    pages = [(1, "u", "same")] * 3 + [(2, "u", "same")] * 2 + [(None, None, "x")] * 2 + [
        (None, "u", "same"), (3, "u", "own"), (3, "u", "other")
    ]
    warc.write_archives(
        spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("row", F.lit("clash")), str(tmp_path / "w")
    )
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len({r.record_id for r in got}) == len(got) == len(pages)
    kinds = sorted((str(r.page_id), r.payload, r.record_type, str(r.refers_to)) for r in got)
    want = [("1", "same", "response", "None")] * 3 + [("2", "same", "revisit", "1")] * 2 + [("None", "x", "response", "None")] * 2 + [("None", "same", "response", "None"), ("3", "own", "response", "None"), ("3", "other", "response", "None")]
    assert kinds == sorted(want)


def test_ridge_and_features_against_direct_solutions(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (400, len(quality.NAMES)))
    y = (x[:, 0] + 0.3 * rng.normal(0, 1, 400) > 0).astype(float)
    rows = spark.createDataFrame(
        [(v.tolist(), float(t), False) for v, t in zip(x, y)], "x array<double>, y double, calibrate boolean"
    ).repartition(7)
    mean, scale, weights, *_ = quality.fit(rows)
    assert np.allclose(mean, x.mean(0)) and np.allclose(scale, x.std(0))
    z = quality.fourier(x, mean, scale)
    ridge = quality.RIDGE * 400 * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    assert np.allclose(z @ weights, z @ np.linalg.solve(z.T @ z + ridge, z.T @ y), atol=1e-6)
    near = z[:, :-1] @ z[:, :-1].T  # approximates the Gaussian kernel
    u = (x - mean) / scale
    kernel = np.exp(-((u[:, None] - u[None]) ** 2).sum(-1) / 2 / quality.WIDTH**2)
    assert np.abs(near - kernel).mean() < 0.06


def test_quality_of_odd_texts_by_a_fitted_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = [
        (90001, None), (90002, ""), (90003, "x" * 3_000_000), (90004, "word " * 400_000), (None, "no id"), (90005, "twin"), (90005, "twin")
    ]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).withColumns(
        {c: F.lit("clash") for c in ("x", "y", "score", "id", "quality")}
    )
    twice = labels.select("doc_id", "quality").union(labels.select("doc_id", "quality")).union(
        spark.createDataFrame([(90001, 7), (None, 1), (90002, None)], "doc_id long, quality int")
    )
    got = quality.classify(both, twice).collect()
    assert len(got) == docs.count() + len(odd) and all(0 <= r.score <= 1 for r in got)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.score)
    assert of[90001] == of[90002] and len(of[90005]) == 1
    right = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and right.get(r.doc_id) is not None]
    assert np.mean([r.predicted == right[r.doc_id] for r in held]) >= 0.9
