"""Operators whose work goes by groups, blocks or cells, with these made small: results stay those of brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from evidentia.llm import bpe, decontam, embeddings, minhash, substring

BLANK = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts():
    """Texts of few words, with a passage in a third of them, parts of it, copies, and long ones."""
    r = random.Random(11)
    word = lambda n=60: f"w{r.randrange(n)}"
    passage = [f"p{i}" for i in range(45)]
    out = []
    for i in range(150):
        own = [word() for _ in range(r.randrange(0, 70))]
        if i % 3 == 0:
            at = r.randrange(len(own) + 1)
            own[at:at] = passage[: r.randrange(18, 46)] if i % 6 else passage
        out.append((i, " ".join(own)))
    out += [
        (200, out[3][1]), (201, "\n".join(out[6][1].split())), (202, "x " * 500), (203, None), (204, ""), (205, "only few words"),
        (3, out[3][1]), (206, " ".join(word(4) for _ in range(3000)))
    ]
    return out


def windows_removed(rows, width=20):
    seen, words = {}, [(i, re.findall(BLANK, t or "")) for i, t in rows]
    for i, w in words:
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            seen[k] = min(seen.get(k, (1 << 60, 0)), (i, a))
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - width + 1):
            if seen[tuple(w[a : a + width])] < (i, a):
                gone.update(range(a, a + width))
        spans = sorted(x for x in gone if x - 1 not in gone), sorted(x + 1 for x in gone if x + 1 not in gone)
        out.append(
            (
                i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest(),
                list(zip(*spans))
            )
        )
    return out


@pytest.mark.parametrize("group_bytes", [1 << 23, 3000])
def test_suffix_trees_with_groups_of_any_size(spark, texts, monkeypatch, group_bytes):
    monkeypatch.setattr(substring, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(substring, "SAMPLED", 2)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 5000)
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("label", "block", "late", "n_words")}
    ).repartition(6)
    if group_bytes == 3000:
        monkeypatch.setattr(substring, "_large", lambda *a: large(*a))
        large = lambda d, size, tasks, i, t, w, g: _all_large(texts, w, g)
    got = substring.remove_repeats(docs, with_spans=True).collect()
    assert sorted(
        (r.doc_id, r.n_words, r.n_removed, r.kept_sha256, [tuple(s) for s in r.repeats]) for r in got
    ) == sorted(windows_removed(texts))


def _all_large(texts, width, gram):
    """Half of all groups, on both levels."""
    block = substring._Block(pa.table({"doc_id": [i for i, _ in texts], "text": [t for _, t in texts]}), "doc_id", "text", width, gram)
    some = lambda v: np.unique(v)[::2]
    return some(block.smallest), some(block.up_to_smallest(np.arange(len(block.at))))


def test_large_groups_are_found(spark, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_BYTES", 1 << 18)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join([f"a{i}b{k}" for k in range(40)] + [passage] + [f"c{i}d{k}" for k in range(40)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first, second = substring._large(docs, sum(len(t) for _, t in rows), 8, "doc_id", "text", 20, 5)
    assert 0 < len(first) < 100 and len(second) <= 100
    got = substring.remove_repeats(docs).collect()
    assert all(r.n_removed == (0 if r.doc_id == 0 else 30) for r in got)


def test_subtree_against_sorted_suffixes():
    r = random.Random(5)
    words = [f"v{r.randrange(3)}" for _ in range(400)]
    width = 6
    runs = pa.table(
        {
            "doc": pa.array([1, 2], pa.int64()), "start": pa.array([0, 0], pa.int64()), "n": pa.array([200 - width + 1] * 2, pa.int32()),
            "text": pa.array([" ".join(words[:200]).encode(), " ".join(words[200:]).encode()])
        }
    )
    tree = substring.Subtree(runs, width)
    text = {1: words[:200], 2: words[200:]}
    prefix = [tuple(text[d][s : s + width]) for d, s in zip(tree.doc.tolist(), tree.start.tolist())]
    for a, b, common in zip(prefix, prefix[1:], tree.common.tolist()):
        assert common == next((k for k in range(width) if a[k] != b[k]), width)
    groups = [k for k, p in enumerate(prefix) if k == 0 or p != prefix[k - 1]]
    assert len(groups) == len(set(prefix))  # equal prefixes stand together
    every = [(d, s, tuple(t[s : s + width])) for d, t in text.items() for s in range(200 - width + 1)]
    first = {}
    for d, s, k in every:
        first.setdefault(k, (d, s))
    late = {(d, s) for d, s, k in every if first[k] != (d, s)}
    assert {x for x, l in zip(zip(tree.doc.tolist(), tree.start.tolist()), tree.late()) if l} == late


def brute_matches(doc, item, width):
    """Maximal common runs of words of at least the item's window: (item_start, doc_start, n_words)."""
    out, need = [], min(width, len(item))
    for a in range(len(item)):
        for b in range(len(doc)):
            if item[a] == doc[b] and not (a and b and item[a - 1] == doc[b - 1]):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n]:
                    n += 1
                if n >= need:
                    out.append((a, b, n))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 400])
def test_longest_matches_and_locations(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block_bytes)
    r = random.Random(7)
    items = [(f"i{k}", " ".join(f"W{r.randrange(30)}" for _ in range(r.randrange(1, 40)))) for k in range(25)] + [
        ("i0", "another text of one id"), ("none", None), ("blank", " ! "), (None, "w1 w2"),
        (None, " ".join(f"n{k}" for k in range(14)))
    ]
    docs = []
    for i in range(60):
        own = [f"w{r.randrange(30)}" for _ in range(r.randrange(0, 60))]
        if i % 4 == 0:
            item = r.choice(items[:25])[1].lower().split()
            at = r.randrange(len(item))
            own[3:3] = item[at : at + r.randrange(5, 30)]
        docs.append((i, " ".join(own)))
    docs += [(100, None), (101, ""), (102, "!!"), (103, docs[0][1]), (103, docs[0][1]), (104, "w1 " * 30000),
        (105, "before " + " ".join(f"N{k}" for k in range(2, 13)) + " after")
    ]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("matches", "n_words", "item_id", "_maybe", "i")}
    ).repartition(5)
    got = decontam.contamination(df, spark.createDataFrame(items, "item_id string, text string"), with_matches=True).collect()
    assert len(got) == len(docs)
    for row in got:
        doc = words(dict(docs)[row.doc_id])
        want = [(name, *m) for name, t in items if len(doc) < 1000 for m in brute_matches(doc, words(t), 10)]
        have = [tuple(m) for m in row.matches]
        if len(doc) < 1000:
            assert set(have) == set(want), row.doc_id
            hit = {p for _, _, b, n in want for p in range(b, b + n)}
            assert (row.n_words, row.n_hit, row.contaminated) == (len(doc), len(hit), bool(hit))
            assert row.items_sha256 == hashlib.sha256(",".join(sorted({m[0] for m in want if m[0]})).encode()).hexdigest()
        if row.doc_id == 105:  # the passage of an item without id
            assert (row.n_hit, row.n_items, row.contaminated) == (11, 0, True)
    none = decontam.contamination(df.limit(0), spark.createDataFrame(items, "item_id string, text string"))
    assert none.count() == 0


def test_minhash_with_small_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 4)
    monkeypatch.setattr(minhash, "CARRIED", 150)
    r = random.Random(3)
    base = [[f"b{k}v{r.randrange(10**6)}" for _ in range(120)] for k in range(6)]
    rows = []
    for i in range(160):
        w = list(base[i % 6])
        for _ in range(r.choice((0, 1, 4, 8, 15, 30))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w + [f"t{k}" for k in range(r.choice((0, 5, 60)))])))
    rows += [(500, rows[0][1]), (0, rows[0][1]), (501, None), (502, "one")]
    sets = {i: (lambda w: {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set())((t or "").split()) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = top(x), top(y)
                up[max(a, b)] = min(a, b)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == {i: top(i) for i in sets}
    assert len({top(i) for i in sets}) < len(sets) - 20


def test_words_are_encoded_wherever_they_stand(spark):
    enc = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.rank_table(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))), special_tokens={}
    )
    rows = [(i, f"the same words {i % 7} in many blocks, the same") for i in range(400)] + [
        (None, "null id"), (401, None), (402, ""), (403, "a" * 300000), (404, "twin"), (404, "twin"), (405, "<|endoftext|>  　é\r\n\t x")
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("clash") for c in ("block", "bucket", "payload", "n_tokens")}
    ).repartition(9)
    out = bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"))
    want = {i: enc.encode_ordinary(t or "") for i, t in rows}
    got = out.collect()
    assert len(got) == len(rows) and all(list(r["ids"]) == want[r.doc_id] for r in got)
    back = bpe.decode(out, P.path("byte_bpe_50k.tiktoken")).collect()
    assert all(bytes(r.bytes).decode() == (dict(rows)[r.doc_id] or "") for r in back)
    with pytest.raises(Exception, match="not of the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [70000])], "doc_id long, ids array<int>"), P.path("byte_bpe_50k.tiktoken")).collect()


def test_components_of_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    chains = []
    for _ in range(40):  # each links to the one before, its ends to nothing else
        x = unit(rng.standard_normal(48))
        for _ in range(rng.integers(2, 9)):
            away = rng.standard_normal(48)
            x = 0.93 * x + np.sqrt(1 - 0.93**2) * unit(away - (away @ x) * x)
            chains.append(x)
    x = np.concatenate([unit(rng.standard_normal((800, 48))), chains])[rng.permutation(800 + len(chains))]
    links = x @ x.T >= 0.9
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in links])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit("clash") for c in ("id", "v", "shelf", "list", "n_links", "component_id", "kind", "a")}).repartition(5)
    got = {r.vec_id: (r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {i: (int(c), int(c) == i) for i, c in enumerate(label)} and len(set(label.tolist())) < len(x) - 100
