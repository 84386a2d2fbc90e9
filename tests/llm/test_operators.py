"""Each operator against brute force on a small fixture that holds the odd cases:
nulls, empty and long texts, ties, repeated rows, clashing column names, empty tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import bpe, chat, decontam, embeddings, langid, minhash, quality, queries, substring, tokenstore, warc

SF = "/root/testdata/sf0.001"
ODD = [
    (9000, None), (9001, ""), (9002, " \n\t"), (9003, "One"), (9004, "one"), (9005, "a b"), (9006, "don't <|endoftext|> 漢字 😀 x  y"),
    (9007, "w " * 30), (9008, "long " * 60000), (9010, "tie tie"), (9010, "tie tie"), (None, "no id here")
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.union(extra).withColumns(
        {c: F.lit("clash") for c in ("n_words", "kept", "ids", "score", "id", "key", "block")}
    ).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def lowered(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def test_minhash(docs, rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        return {tuple(w[a : a + 2]) for a in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} - {()}

    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = top(x), top(y)
                up[max(a, b)] = min(a, b)
    got = minhash.near_duplicates(docs, width=2).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), top(r.doc_id) == r.doc_id)


def test_odd_sketch_never_rejects_similar_sets():
    rng = np.random.default_rng(3)
    for n in (10, 100, 1000, 20000):
        for _ in range(20):
            common = rng.integers(0, 2**64, n, dtype=np.uint64)
            extra = rng.integers(0, 2**64, n // 4, dtype=np.uint64)
            x, y = np.unique(np.concatenate([common, extra[: n // 8]])), np.unique(np.concatenate([common, extra[n // 8 :]]))
            one, two = ((np.array([len(s)]), np.array([k]), b[None]) for s in (x, y) for k, b in [minhash.odd_sketch(s)])
            assert minhash.allowed(one, two, 80)[0].all()


def test_odd_sketch_keeps_thousands_of_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    for union in (60, 150, 200, 300, 600, 1200):
        for part in (0.0, 0.5):  # one set holds the other, or both are of one size
            both, sketches = -(-union * 4 // 5), ([], [])
            cut = both + int((union - both) * part)
            for _ in range(2500):
                h = rng.integers(0, 2**64, union, dtype=np.uint64)
                for of, one in zip(sketches, (h[:cut], np.concatenate([h[:both], h[cut:]]))):
                    of.append((len(one), *minhash.odd_sketch(np.sort(one))))
            x, y = ((np.array([s[0] for s in of]), np.array([s[1] for s in of]), np.stack([s[2] for s in of])) for of in sketches)
            assert minhash.allowed(x, y, 80)[0].all()


def test_substring(docs, rows):
    seen, want = {}, {}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    key = lambda i, a: (i is not None, i or 0, a)
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            seen[k] = min(seen.get(k, (True, 1 << 60, 0)), key(i, a))
    for i, t in rows:
        w, gone = words(t), set()
        for a in range(len(w) - 19):
            if seen[tuple(w[a : a + 20])] < key(i, a):
                gone.update(range(a, a + 20))
        want.setdefault(i, []).append(
            (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
        )
    got = {}
    for r in substring.remove_repeats(docs, with_spans=True).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
        assert sum(s.past - s.first for s in r.repeats) == r.n_removed
    assert got == want


def test_substring_ships_the_words_of_every_open_window():
    text = " ".join(f"w{i * i % 97}" for i in range(200))
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    block = substring._Block(pa.table({"doc_id": [1, 2], "text": [text, "x\n" + text[50:]]}), "doc_id", "text", 20, 5, spelled=True)
    assert block.prints(77, none)["prints"].to_pylist()[-1] == b"" and sum(
        len(x) for x in block.prints(77, none)["prints"].to_pylist()
    ) == 4 * len(block.open)
    runs = block.runs(77, none, [np.arange(len(block.open), dtype=np.uint32).tobytes()]).to_pylist()
    assert runs.pop() == {"label": 77, "block": 77, "place": 0, "n": 0, "doc": 0, "start": 0, "text": b""}
    words = {1: text.split(), 2: ["x", *text[50:].split()]}
    seen = []
    for r in runs:
        assert r["text"].decode().split(" ") == words[r["doc"]][r["start"] : r["start"] + r["n"] + 19]
        seen += [(r["doc"], r["start"] + i) for i in range(r["n"])]
    assert seen == list(zip(block.doc[block.open].tolist(), block.start[block.open].tolist()))


def test_decontamination(spark, docs, rows):
    items = [(i, t) for i, t in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [
        (900, "is THE"), (901, None), (902, "!?"), (None, "of the")
    ]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        d = min(10, len(w))
        for a in range(len(w) - d + 1) if d else ():  # words of items without id are hit, too
            windows.setdefault(tuple(w[a : a + d]), set()).update([] if i is None else [str(i)])
    want = {}
    for i, t in rows:
        w, hit, own = words(t), set(), set()
        for a in range(len(w)):
            for n in {len(k) for k in windows}:
                if tuple(w[a : a + n]) in windows and a + n <= len(w):
                    hit.update(range(a, a + n))
                    own |= windows[tuple(w[a : a + n])]
        want[i] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, bench).collect()}
    assert got == want
    assert not any(want[r.doc_id][4] for r in decontam.decontaminated(docs, bench).select("doc_id").collect())
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_bpe(docs, rows):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.rank_table(bpe.read_ranks(path)), special_tokens={})
    want = {i: enc.encode_ordinary(t) for i, t in rows}
    out = bpe.encode(docs, path)
    for r in out.collect():
        assert list(r["ids"]) == want[r.doc_id] and r.n_tokens == len(r["ids"])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
    text = dict(rows)
    assert all(bytes(r.bytes).decode() == text[r.doc_id] for r in bpe.decode(out, path).collect())


def test_token_store(spark, docs, rows, tmp_path):
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    tokenstore.write_tokens(docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json"))
    got = tokenstore.checksums(tokenstore.placed_tokens(spark, str(tmp_path / "t"))).collect()
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tk.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    plan = tokenstore.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 7").select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def test_op6_takes_special_tokens_as_the_library_does(spark, tmp_path):
    end = "<|endoftext|>"
    texts = ["plain words", f"one {end} two", "more plain", end, f"{end}{end} x", "<|endoftext", None, f"  {end}  y", "last"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    tk, at, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for i, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op6_token_store(spark, str(tmp_path)).collect())) == want


def test_warc(spark, tmp_path):
    pages = [
        (i, f"http://x/{i}", h) for i,
        h in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "<p>a</p>", "x\r\n\r\nWARC/1.1\r\n\r\n", "é" * 70000])
    ] + [(2, "http://x/2\r\nX: y", "<p>a</p>"), (None, None, "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    warc.write_archives(df, str(tmp_path / "w"))
    got = sorted(
        (
            tuple(r) for r in warc.read_archives(spark, str(tmp_path / "w")).select(
                "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"
            ).collect()
        ),
        key=str
    )
    want, first = [], {}
    for i, _, h in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (h or "").encode()
        o = first.setdefault(b, i)
        same = i == o
        want.append(
            (
                i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else o,
                h or ""
            )
        )
    assert got == sorted(want, key=str)


def test_warc_keeps_different_payloads_of_one_page_id(spark, tmp_path):
    pages = [
        (1, "u1", "same"), (2, "u2", "same"), (2, "u2", "only here"), (3, "u3", "only here"), (4, "u4", "other"), (5, "u5", "other"),
        (5, "u5", "same")
    ]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).select("page_id", "payload", "payload_bytes", "record_type", "refers_to").collect()
    want = [
        (1, "same", 4, "response", None), (2, "same", 4, "revisit", 1), (2, "only here", 9, "response", None),
        (3, "only here", 9, "revisit", 2)
    ]
    want += [(4, "other", 5, "response", None), (5, "other", 5, "revisit", 4), (5, "same", 4, "revisit", 1)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    near = np.repeat(base[:20], 8, axis=0) + 0.05 * rng.standard_normal((160, 16))
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0]), (1005, []), (0, rows[0][1])]
    got = {
        r.vec_id: r for r in embeddings.near_duplicate_vectors(
            spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
        ).collect()
    }
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.9 * links.sum() <= found <= links.sum()
    assert all(got[i].n_links <= links[i].sum() for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(1000, 1006))


def test_vectors_finds_links_across_many_lists(spark):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    base = unit(rng.standard_normal((6000, 64)))
    away = rng.standard_normal((600, 64))
    away = unit(away - (away * base[:600]).sum(1)[:, None] * base[:600])
    x = np.concatenate([base, 0.905 * base[:600] + np.sqrt(1 - 0.905**2) * away])
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    got = embeddings.near_duplicate_vectors(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    )
    assert links.sum() >= 1200
    assert {r.vec_id: r.n_links for r in got.collect()} == dict(enumerate(links.sum(1).tolist()))


def test_vectors_are_sent_to_tasks_that_do_not_grow_with_them():
    for n in (100_000, 200_000, 800_000, 1_500_000):  # rows sent of a vector that asks all lists, on both sides
        assert -(-n // embeddings.chunk_rows(n)) <= embeddings.SPLIT
    assert embeddings.chunk_rows(100) == embeddings.CHUNK and embeddings.chunk_rows(10**8) == embeddings.LARGEST


@pytest.mark.parametrize("chunk", [40, 700])
def test_vectors_link_across_shelves_and_chunks_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rng = np.random.default_rng(11)
    x = np.repeat(rng.standard_normal((60, 8)), 10, axis=0) + 0.2 * rng.standard_normal((600, 8))
    x = x[rng.permutation(600)].astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    low = np.arange(600)
    while (low != (new := np.where(links, low, 600).min(axis=1).clip(max=low))).any():
        low = new
    got = embeddings.near_duplicate_vectors(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    ).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(links[i].sum()), int(low[i])) for i in range(600)}


def test_vectors_of_every_length_link(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [3.0, 0.1, 0.0]), (6, [1.0])]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [
        (1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)
    ]


def test_language_id_held_out(spark, docs):
    full = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = langid.train(full.where(fold != 1), P.path("piece_bpe_32k.model"))
    r = langid.identify(full, model).where(fold == 1).collect()
    assert sum(x.lang == x.lang_pred for x in r) >= 0.95 * len(r) and all(0 <= x.score <= 1 for x in r)
    odd = {x.doc_id: x.lang_pred for x in langid.identify(docs.where("doc_id between 9000 and 9002"), model).collect()}
    assert set(odd.values()) == {"und"}
    assert {
        x.lang_pred for x in langid.identify(docs, langid.train(full.where("false"), P.path("piece_bpe_32k.model"))).collect()
    } == {"und"}


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(["▁", "a", "b", "▁a", "ab", "▁ab", "aba"])
    prob = np.random.default_rng(0).uniform(0.01, 0.2, (8, 1))
    p = {x: prob[i + 1, 0] for i, x in enumerate(["▁", "a", "b", "▁a", "ab", "▁ab", "aba"])}

    def total(s):
        return 1.0 if not s else sum(p.get(s[:n], prob[0, 0] if n == 1 else 0) * total(s[n:]) for n in range(1, len(s) + 1))

    got = langid.Scorer(["▁", "a", "b", "▁a", "ab", "▁ab", "aba"], ["x"], prob).likelihoods(["abab", "c", "aba"])
    assert np.allclose(np.exp(got[:, 0]), [total("▁abab"), total("▁c"), total("▁aba")])
    assert lattice.n == 8


def test_quality_held_out(spark, docs):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = quality.classify(d, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([x.predicted == x.quality for x in r]) >= 0.9
    odd = quality.classify(docs, labels.limit(0)).collect()
    assert {x.score for x in odd} == {0.5} and len(odd) == docs.count()


def test_isotonic():
    assert quality.isotonic(np.array([0.0, 0.5, 0.2, 1.0]), np.ones(4)).tolist() == [0.0, 0.35, 0.35, 1.0]


def test_chat_recovers_roles(spark):
    r = chat.recovered(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).where("held_out").collect()
    assert sum(x.n_right for x in r) >= 0.9 * sum(x.n_lines for x in r)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "User: hi\nthere\nAI: yes")], "i long, transcript string")
    model = chat.fit(chat.transcripts_of(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")))
    got = {x.i: x for x in chat.parse(odd, model).collect()}
    assert got[1].rendered == got[2].rendered == ""
    assert [(t.role, t.text) for t in got[3].turns] == [("user", "hi\nthere"), ("assistant", "yes")]


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    assert minhash.near_duplicates(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert bpe.encode(none, P.path("byte_bpe_50k.tiktoken")).count() == 0
    assert quality.classify(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
    tokenstore.write_tokens(none, str(tmp_path / "s"), P.path("byte_bpe_50k.json"))
    assert tokenstore.placed_tokens(spark, str(tmp_path / "s")).count() == 0
    assert chat.recovered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
