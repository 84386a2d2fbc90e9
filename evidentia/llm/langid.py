"""Language identification by unigrams over subword pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary, lower-cased, letters only. Each language
has a probability for every piece. The likelihood of a word is the sum over all ways to cut it
into pieces, by a forward pass; a text's likelihood is the product over its words, the
maximal runs of letters, of any length. A task scores a word that repeats once (it
remembers REMEMBERED words at most).
Probabilities come from expected piece counts (forward-backward, ROUNDS rounds) over a
sample of about SAMPLE_DOCS labelled texts per language, taken by the hash of the id.

Defined results: a null text or one without letters is `und` with score 0, and so is
every text if nothing could be learned. An empty table stays empty; extra columns stay, those named
lang_pred or score are replaced; repeated rows get equal results. score is the posterior probability of the
predicted language, all learned languages being equally likely before; of equally likely
ones the first in string order is taken.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import kernel as K
from evidentia.llm.storage import prepare, release_memory, trimmed

SAMPLE_DOCS = 1000
ROUNDS = 2
UNKNOWN = "und"
_BOUNDARY = "▁"
_BLOOM = 20
#: Letters of a run whose lattice is held at once; longer runs carry the sums of their last letters on.
AT_ONCE = 4096
#: Words whose likelihoods a task remembers; beyond this it starts over, scores stay the same.
REMEMBERED = 1 << 18


def public_pieces(model_path: str) -> list[str]:
    """The vocabulary's pieces as this operator uses them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.replace(_BOUNDARY, "").isalpha() and p.rfind(_BOUNDARY) <= 0)


class Lattice:
    """Which pieces stand where in a set of words."""

    def __init__(self, pieces: list[str]):
        text = "".join(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        start = np.cumsum(size) - size
        hashes = K.span_hashes(K._CodePoints(_points(text)), start, start + size)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], (order + 1).astype(np.int32)
        self.bloom = np.zeros(1 << _BLOOM, bool)
        self.bloom[self.hashes >> np.uint64(64 - _BLOOM)] = True
        self.n = len(pieces) + 1
        self.longest = int(size.max(initial=1))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.bloom[hashes >> np.uint64(64 - _BLOOM)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == hashes[maybe], self.ids[at], 0)
        return out

    def pieces_at(self, values: np.ndarray) -> np.ndarray:
        """Piece ids by [word, first letter, length - 1] for words of one length, given as letter values."""
        power, inverse = K._powers()
        n = values.shape[1]
        total = np.zeros((len(values), n + 1), np.uint64)
        np.cumsum(values * power[:n], axis=1, out=total[:, 1:])
        ids = np.zeros((len(values), n, min(n, self.longest)), np.int32)
        for l in range(1, ids.shape[2] + 1):
            h = K.mix64((total[:, l:] - total[:, :-l]) * inverse[: n - l + 1] + np.uint64(l))
            ids[:, : n - l + 1, l - 1] = self.lookup(h.reshape(-1)).reshape(h.shape)
        return ids

    def groups(self, words: list[str]):
        """(indexes of words, letter values) for each length, in parts of bounded size."""
        marked = [_BOUNDARY + w for w in words]
        size = np.array([len(w) for w in marked], np.int64)
        points = _points("".join(marked))
        value = K._CodePoints(points)[0 : len(points)]
        start = np.cumsum(size) - size
        for n in np.unique(size).tolist():
            index = np.flatnonzero(size == n)
            for part in np.array_split(index, -(-len(index) * n // 200_000)):
                yield part, value[start[part][:, None] + np.arange(n)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def forward(ids: np.ndarray, prob: np.ndarray, begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, logs): sums[word, t, language] * exp(logs[word, t, language]) is the sum over all segmentations of the first t letters.

    prob is [piece, language]; row 0 is the probability of a letter that is no piece. Sums are scaled
    every few letters, so a run of any length stays within the range of numbers. begun
    holds the sums of the first letters where these are known, all of one scale.
    """
    w, n, longest = ids.shape
    digits = max(1.0, -np.log10(prob.min()))
    every = max(1, int(120 / digits))
    kind = np.float64 if digits * (longest + every) < 290 else np.longdouble
    done = 1 if begun is None else begun.shape[1]
    sums, logs, scale = np.zeros((w, n + 1, prob.shape[1]), kind), np.zeros((w, n + 1, prob.shape[1])), np.zeros((w, prob.shape[1]))
    sums[:, :done] = 1 if begun is None else begun
    known = prob.copy()
    known[0] = 0
    for t in range(done, n + 1):
        for l in range(1, min(t, longest) + 1):
            sums[:, t] += sums[:, t - l] * (prob if l == 1 else known)[ids[:, t - l, l - 1]]
        logs[:, t] = scale
        if t % every == 0 or t == n:
            first = max(0, t - longest)
            by = sums[:, t].copy()
            sums[:, first : t + 1] /= by[:, None]
            scale = scale + np.log(by).astype(float)
            logs[:, first : t + 1] = scale[:, None]
    return sums, logs


def _backward(ids: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for all letters from t on: forward sums of the words read backwards."""
    n = ids.shape[1]
    turned = np.zeros_like(ids)
    for l in range(1, ids.shape[2] + 1):
        turned[:, : n - l + 1, l - 1] = ids[:, n - l :: -1, l - 1]
    sums, logs = forward(turned, prob)
    return sums[:, ::-1], logs[:, ::-1]


def log_likelihood(lattice: Lattice, values: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """log P(word | language) of words of one length, AT_ONCE letters of the lattice at a time."""
    total, begun, at, n = 0.0, None, 0, values.shape[1]
    while at < n:
        back = 0 if begun is None else begun.shape[1] - 1
        past = min(n, at + AT_ONCE)
        sums, logs = forward(lattice.pieces_at(values[:, at - back : past]), prob, begun)
        total = total + logs[:, -1] + np.log(sums[:, -1]).astype(float)
        begun, at = sums[:, max(0, sums.shape[1] - 1 - lattice.longest) :] / sums[:, -1:], past
    return total


def learned(lattice: Lattice, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """[piece, language] probabilities from words counted by language."""
    groups = [(part, lattice.pieces_at(values)) for part, values in lattice.groups(words)]
    n_langs = counts.shape[1]
    first = np.zeros((lattice.n, n_langs))
    for part, ids in groups:
        flat = ids.reshape(len(part), -1)
        for k in range(n_langs):
            first[:, k] += np.bincount(flat.reshape(-1), np.repeat(counts[part, k], flat.shape[1]), lattice.n)
    first[0] = 1
    prob = _normalised(first)
    for _ in range(rounds):
        expected = np.zeros((lattice.n, n_langs))
        for part, ids in groups:
            n, longest = ids.shape[1:]
            (alpha, a_log), (beta, b_log) = forward(ids, prob), _backward(ids, prob)
            whole = (a_log[:, n] + np.log(alpha[:, n]).astype(float))[:, None]
            for l in range(1, longest + 1):
                own = ids[:, : n - l + 1, l - 1]
                p = prob[own] if l == 1 else np.where(own[..., None] > 0, prob[own], 0)
                share = alpha[:, : n - l + 1] * p * beta[:, l:] * np.exp(
                    a_log[:, : n - l + 1] + b_log[:, l:] - whole
                ) * counts[part][:, None]
                for k in range(n_langs):
                    expected[:, k] += np.bincount(own.reshape(-1), share[..., k].astype(float).reshape(-1), lattice.n)
        prob = _normalised(expected)
    return prob


def _normalised(counts: np.ndarray) -> np.ndarray:
    smooth = counts + 0.1
    return smooth / smooth.sum(axis=0)


class Scorer:
    def __init__(self, pieces: list[str], langs: list[str], prob: np.ndarray):
        self.lattice, self.langs, self.prob = Lattice(pieces), langs, prob
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.known = np.zeros((1024, len(self.langs)))

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """log P(word | language) for every word."""
        out = np.zeros((len(words), len(self.langs)))
        for part, values in self.lattice.groups(words) if words else ():
            out[part] = log_likelihood(self.lattice, values, self.prob)
        return out

    def _remembered(self, p: K.Pieces) -> np.ndarray:
        """Likelihoods of all words of a slice; those of words seen before in this task are looked up."""
        at, inverse = K.distinct_at(p.hash)
        keys = p.hash[at].tolist()
        if len(self.place) > REMEMBERED:
            self._forget()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        base = len(self.place)
        self.place |= {keys[i]: base + j for j, i in enumerate(new)}
        while len(self.known) < len(self.place):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[base : base + len(new)] = self.likelihoods([p.text[p.start[at[i]] : p.end[at[i]]] for i in new])
        return self.known[np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))][inverse]

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for p in K.letter_runs(column, 4 << 20):
            total = np.zeros((len(p.start) + 1, len(self.langs)))
            if len(p.start):
                np.cumsum(self._remembered(p), axis=0, out=total[1:])
            ll = total[p.first[1:]] - total[p.first[:-1]]
            best = ll.argmax(axis=1)
            post = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
            empty = p.first[1:] == p.first[:-1]
            names += [UNKNOWN if e else self.langs[b] for e, b in zip(empty.tolist(), best.tolist())]
            scores.append(np.where(empty, 0.0, post))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def _counted(batches):
    """(lang, word, n) of every batch."""
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for p in K.letter_runs(batch.column(0)):
            words, inverse = p.distinct()
            for lang in sorted(set(langs[p.lo : p.hi])):
                mine = np.repeat([x == lang for x in langs[p.lo : p.hi]], np.diff(p.first))
                n = np.bincount(inverse[mine], minlength=len(words))
                at = np.flatnonzero(n)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(at)), pa.array([words[i] for i in at.tolist()]), pa.array(n[at], pa.int64())],
                        names=["lang", "word", "n"]
                    )


def train(
    labelled: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS
):
    """(pieces, languages, probabilities) from rows whose lang is not null."""
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    many = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row per language
    langs = sorted(many)
    pieces = public_pieces(model_path)
    if not langs:
        return pieces, langs, np.zeros((len(pieces) + 1, 0))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30))
    most = functools.reduce(lambda e, l: e.when(F.col(lang_col) == l, F.lit(int((1 << 30) * min(1, sample_docs / many[l])))), langs, F)
    counted = rows.where(place < most).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(
        _counted, "lang string, word string, n long"
    )
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).coalesce(1)

    def fit(batches):
        index: dict[str, int] = {}
        at, of, n = [], [], []
        for batch in batches:
            for lang, word, count in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at.append(index.setdefault(word, len(index)))
                of.append(langs.index(lang))
                n.append(count)
        counts = np.zeros((len(index), len(langs)))
        np.add.at(counts, (at, of), n)
        if index:
            prob = learned(Lattice(pieces), list(index), counts)
            yield pa.RecordBatch.from_pydict({"prob": pa.array([prob.tobytes()], pa.binary())})

    got = counted.mapInArrow(fit, "prob binary").collect()  # pieces x languages doubles
    if not got:
        return pieces, [], np.zeros((len(pieces) + 1, 0))
    return pieces, langs, np.frombuffer(got[0][0]).reshape(len(pieces) + 1, len(langs))


def identify(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    prepare(docs.sparkSession)
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages
    schema = docs.schema

    def run(batches):
        scorer = Scorer(*shared.value) if shared.value[1] else None
        for batch in trimmed(batches):
            if scorer:
                names, scores = scorer.predict(batch.column(schema.names.index(text_col)))
            else:
                names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*schema.names, "lang_pred", "score"]
            )
        del scorer
        release_memory()

    from pyspark.sql import types as T

    return docs.mapInArrow(
        run, T.StructType([*schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    )
