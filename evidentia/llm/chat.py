"""Chat transcripts to canonical turns: a hidden Markov model over lines.

Every line shows a speaker marker (or none), its length, how it opens and ends, and how many
sentences it holds. A hidden state says whose line it is and whether it begins a turn. Start,
transition and emission probabilities are counted, smoothed, from transcripts whose lines are
labelled, and kept as whole numbers (logarithms times 2**20), so sums do not depend on their order. Viterbi
finds the likeliest states of a transcript, for all transcripts of a batch in step.

A conversation of any length is decoded as one: it travels in parts of PART_TURNS turns, each
part is summed up as its best scores from every state before it to every last state (36 numbers), these are
chained over the conversation, and each part is then decoded between its known ends.

Turns lose their markers and are rendered in one canonical form, in which a text
cannot forge a marker: after `<`, bars of a text are doubled by one (`<|` becomes `<||`).

Defined results: a null or empty transcript has no lines, no turns and renders to the empty
string; a null turn number counts as 0, a null text as empty, other and null roles as user; turns of one number are ordered by
role and text. Lines are kept whole and in order. Of equally likely paths the one with the smaller state at the last
place where they differ wins, parts being settled from the last to the first. Columns of the input with a name that the operator returns are replaced.
An empty table has no rows, and a model learned from nothing has all paths equally likely.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm.storage import prepare, written

ROLES = ("assistant", "system", "user")
# Names by which transcripts mark their speakers.
MARKS = {"assistant": ("assistant", "ai", "bot", "model"), "system": ("system", "instructions"), "user": ("user", "human", "question", "q")}
_NAMES = "|".join(n for names in MARKS.values() for n in names)
MARKER = re.compile(rf"^\s*(?:<\|({_NAMES})\|>|\*\*({_NAMES}):\*\*|\[({_NAMES})\]|#+ *({_NAMES}) *:?|({_NAMES}) *:)\s?", re.I)
_ROLE_OF = {n: k for k, r in enumerate(ROLES) for n in MARKS[r]}
#: State 2k begins a turn of role k, 2k + 1 continues it.
STATES = 2 * len(ROLES)
#: What is observed of a line, and how many values it has; lengths and sentences count by powers of two.
CUES = {"mark": len(ROLES) + 1, "length": 32, "opens": 5, "ends": 6, "sentences": 32}
MIXED = {"mark": 0.001, "length": 0.02, "opens": 0.02, "ends": 0.02, "sentences": 0.02}
_SIZES = {"start": (STATES,), "step": (STATES, STATES)} | {name: (STATES, n) for name, n in CUES.items()}
_STOPS = re.compile(r"[.!?](?=\s|$)")
_UNIT = 1 << 20
PART_TURNS = 256


def observed(lines: list[str]) -> np.ndarray:
    """[line, cue] in the order of CUES; the marker is a role's number, or their count for none."""
    out = np.zeros((len(lines), len(CUES)), np.int64)
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        rest = line[m.end() :] if m else line
        head, tail = rest.lstrip()[:1], rest.rstrip()[-1:]
        opens = 0 if not head else 1 if head.isupper() else 2 if head.islower() else 3 if head.isdigit() else 4
        ends = 0 if not tail else 1 if tail == "." else 2 if tail == "?" else 3 if tail in "!:" else 4 if tail.isalnum() else 5
        out[i] = (
            _ROLE_OF[m[m.lastindex].lower()] if m else len(ROLES), min(31, len(rest).bit_length()), opens, ends,
            min(31, len(_STOPS.findall(rest)).bit_length())
        )
    return out


def states_of(truth: str) -> np.ndarray:
    """States from one letter a line: a role's initial, upper-case where a turn begins."""
    initials = [r[0] for r in ROLES]
    return np.array([2 * initials.index(c.lower()) + c.islower() for c in truth], np.int64)


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities, as whole numbers of 2**-20, from rows (transcript, truth)."""
    prepare(labelled.sparkSession)

    def count(batches):
        sums = {k: np.zeros(s, np.int64) for k, s in _SIZES.items()}
        for batch in batches:
            for text, truth in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not truth:
                    continue
                s, o = states_of(truth), observed(text.split("\n"))
                np.add.at(sums["start"], s[0], 1)
                np.add.at(sums["step"], (s[:-1], s[1:]), 1)
                for k, name in enumerate(CUES):
                    np.add.at(sums[name], (s, o[:, k]), 1)
        for name, n in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"name": pa.array([name] * n.size), "at": pa.array(range(n.size), pa.int32()), "n": pa.array(n.reshape(-1), pa.int64())}
            )

    rows = labelled.select("transcript", "truth").mapInArrow(  # a row per parameter
        count, "name string, at int, n long"
    ).groupBy("name", "at").agg(F.sum("n")).collect()
    counts = {k: np.zeros(s) for k, s in _SIZES.items()}
    for name, at, n in rows:
        counts[name].reshape(-1)[at] += n
    model = {k: counts[k] + 0.5 for k in ("start", "step")}
    for name in CUES:  # mixed with the cue's shares in all states, so that a value never seen speaks for no state
        share = (counts[name].sum(axis=0) + 0.5) / (counts[name].sum() + 0.5 * CUES[name])
        own = np.maximum(counts[name].sum(axis=1, keepdims=True), 1)
        model[name] = (1 - MIXED[name]) * counts[name] / own + MIXED[name] * share
    for k in range(STATES):  # a turn is continued by its own role only
        for j in range(1, STATES, 2):
            if j // 2 != k // 2:
                model["step"][k, j] = 1e-9
    model["start"][1::2] = 1e-9
    return {k: np.rint(np.log(v / v.sum(axis=-1, keepdims=True)) * _UNIT).astype(np.int64) for k, v in model.items()}


class _Steps:
    """Sequences of observations, longest first, their emissions in one table without gaps."""

    def __init__(self, model: dict[str, np.ndarray], observations: list[np.ndarray]):
        size = np.array([len(o) for o in observations], np.int64)
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        flat = np.concatenate([observations[k] for k in self.order.tolist()]) if len(size) else np.zeros((0, len(CUES)), np.int64)
        self.emit = sum(model[name].T[flat[:, k]] for k, name in enumerate(CUES))
        self.at = np.cumsum(self.size) - self.size
        self.longest = int(self.size.max(initial=0))

    def live(self, t: int) -> int:
        """How many sequences have a line t."""
        return int(np.searchsorted(-self.size, -t, side="left"))


def viterbi(
    model: dict[str, np.ndarray], observations: list[np.ndarray], before: np.ndarray | None = None, last: np.ndarray | None = None
) -> list[np.ndarray]:
    """The likeliest states of every sequence, all sequences in step.

    before has the state before each sequence, -1 where it begins a conversation; last the state it must end in.
    """
    s = _Steps(model, observations)
    n = s.live(0)
    back = np.zeros((len(s.emit), STATES), np.int8)
    begin = np.full(len(s.order), -1) if before is None else before[s.order]
    score = np.where(begin[:n, None] < 0, model["start"], model["step"][begin[:n]]) + s.emit[s.at[:n]]
    for t in range(1, s.longest):
        m = s.live(t)
        paths = score[:m, :, None] + model["step"][None]
        back[s.at[:m] + t] = paths.argmax(axis=1)
        score[:m] = paths.max(axis=1) + s.emit[s.at[:m] + t]
    flat = np.zeros(len(s.emit), np.int64)
    at = score.argmax(axis=1) if last is None else last[s.order][:n].copy()
    for t in range(s.longest - 1, -1, -1):
        m = s.live(t)
        flat[s.at[:m] + t] = at[:m]
        at[:m] = back[s.at[:m] + t, at[:m]]
    out = [None] * len(s.order)
    for k, a, size in zip(s.order.tolist(), s.at.tolist(), s.size.tolist()):
        out[k] = flat[a : a + size]
    return out


def transfers(model: dict[str, np.ndarray], observations: list[np.ndarray]) -> np.ndarray:
    """[sequence, state before, last state]: best scores; the row after the last state's is that of a beginning."""
    s = _Steps(model, observations)
    n = s.live(0)
    score = np.concatenate([model["step"], model["start"][None]])[None] + s.emit[s.at[:n]][:, None]
    for t in range(1, s.longest):
        m = s.live(t)
        score[:m] = (score[:m, :, :, None] + model["step"][None, None]).max(axis=2) + s.emit[s.at[:m] + t][:, None]
    out = np.zeros((len(s.order), STATES + 1, STATES), np.int64)
    out[s.order[:n]] = score
    return out


def chained(moves: list[np.ndarray]) -> list[tuple[int, int]]:
    """(state before, last state) of every part of a conversation on its likeliest path; -1 before the first."""
    best = [moves[0][STATES]]
    for move in moves[1:]:
        best.append((best[-1][:, None] + move[:STATES]).max(axis=0))
    last, out = int(best[-1].argmax()), []
    for k in range(len(moves) - 1, 0, -1):
        before = int((best[k - 1] + moves[k][:STATES, last]).argmax())
        out.append((before, last))
        last = before
    return [(-1, last), *reversed(out)]


def turns_of(lines: list[str], states: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of every turn, without markers."""
    turns: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, states.tolist()):
        if s % 2 == 0 or not turns:
            turns.append((ROLES[s // 2], [unmarked(line)]))
        else:
            turns[-1][1].append(line)
    return [(r, "\n".join(t)) for r, t in turns]


def unmarked(line: str) -> str:
    m = MARKER.match(line)
    return line[m.end() :] if m else line


def rendered(lines: list[str], states: np.ndarray, begins: bool = True, ends: bool = True) -> str:
    """The canonical form; that of a conversation is those of its parts one after the other."""
    out = []
    for i, (line, s) in enumerate(zip(lines, states.tolist())):
        if s % 2 == 0 or begins and i == 0:
            out.append(("" if begins and i == 0 else "<|end|>\n") + f"<|{ROLES[s // 2]}|>\n")
            line = unmarked(line)
        out.append(re.sub(r"<(\|+)", r"<|\1", line) + "\n")
    return "".join(out) + ("<|end|>\n" if ends and out else "")


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def letters(states: np.ndarray) -> str:
    return "".join(ROLES[s // 2][0] if s % 2 else ROLES[s // 2][0].upper() for s in states.tolist())


_TURN = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def parse(transcripts: DataFrame, model: dict[str, np.ndarray], text_col: str = "transcript") -> DataFrame:
    """transcripts with states (one letter a line), turns (role, text) and rendered."""
    prepare(transcripts.sparkSession)
    transcripts = transcripts.drop(*[c for c in ("states", "turns", "rendered") if c in transcripts.columns])
    schema = transcripts.schema

    def run(batches):
        for batch in batches:
            lines = [lines_of(t) for t in batch.column(schema.names.index(text_col)).to_pylist()]
            paths = viterbi(model, [observed(x) for x in lines])
            turns = [turns_of(x, p) for x, p in zip(lines, paths)]
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            own = [
                pa.array(map(letters, paths), pa.string()), pa.array([[{"role": r, "text": t} for r, t in x] for x in turns], kind),
                pa.array([rendered(x, p) for x, p in zip(lines, paths)], pa.string())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*schema.names, "states", "turns", "rendered"])

    return transcripts.mapInArrow(
        run,
        T.StructType(
            [
                *schema.fields, T.StructField("states", T.StringType()), T.StructField("turns", _TURN),
                T.StructField("rendered", T.StringType())
            ]
        )
    )


def parse_parts(parts: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(conv_id, part, truth, states, rendered) for parts (conv_id, part, transcript, truth) of conversations, each conversation decoded as one."""
    prepare(parts.sparkSession)
    kind = parts.schema["conv_id"].dataType

    def sum_up(batches):
        for batch in batches:
            moves = transfers(model, [observed(t.split("\n")) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(moves.reshape(len(moves), -1).tolist(), pa.list_(pa.int64()))],
                names=["conv_id", "part", "moves"]
            )

    def chain(batches):
        held: list[tuple] = []

        def done():
            ends = chained([np.array(m).reshape(STATES + 1, STATES) for _, _, m in held])
            conv, part = [h[0] for h in held], [h[1] for h in held]
            return [*zip(conv, part, (b for b, _ in ends), (a for _, a in ends), [False] * (len(held) - 1) + [True])]

        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and held[0][0] != row[0]:
                    out += done()
                    held = []
                held.append(row)
            if out:
                yield ends_of(out)
        if held:
            yield ends_of(done())

    def ends_of(rows):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], to_arrow_type(kind)), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))],
            names=["c", "p", "before", "last", "ends"]
        )

    def decode(batches):
        for batch in batches:
            conv, part, text, truth, before, last, ends = batch.columns
            lines, before = [t.split("\n") for t in text.to_pylist()], np.asarray(before).astype(np.int64)
            paths = viterbi(model, [observed(x) for x in lines], before, np.asarray(last).astype(np.int64))
            said = [rendered(x, p, b < 0, e) for x, p, b, e in zip(lines, paths, before.tolist(), ends.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [conv, part, truth, pa.array(map(letters, paths), pa.string()), pa.array(said, pa.string())],
                names=["conv_id", "part", "truth", "states", "rendered"]
            )

    own = lambda *fields: T.StructType([T.StructField(n, k) for n, k in fields])
    moves = parts.select("conv_id", "part", "transcript").mapInArrow(
        sum_up, own(("conv_id", kind), ("part", T.LongType()), ("moves", T.ArrayType(T.LongType())))
    )
    moves = moves.repartition("conv_id").sortWithinPartitions("conv_id", "part")  # a row per part
    ends = moves.mapInArrow(
        chain, own(("c", kind), ("p", T.LongType()), ("before", T.IntegerType()), ("last", T.IntegerType()), ("ends", T.BooleanType()))
    )
    full = parts.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    full = full.select("conv_id", "part", "transcript", "truth", "before", "last", "ends")
    return full.mapInArrow(
        decode,
        own(("conv_id", kind), ("part", T.LongType()), ("truth", T.StringType()), ("states", T.StringType()), ("rendered", T.StringType()))
    )


def _prefix(conv: Column, turn: Column, role: Column) -> Column:
    """The marker of a turn: one of five styles by conversation; one turn in six has none."""
    style, name = F.pmod(F.xxhash64(conv), F.lit(5)), F.initcap(role)
    named = F.when(role == "assistant", "AI").when(role == "user", "Human").otherwise(name)
    marked = (
        F.when(style == 0, F.concat(name, F.lit(": ")))
        .when(style == 1, F.concat(F.lit("**"), name, F.lit(":** ")))
        .when(style == 2, F.concat(F.lit("<|"), role, F.lit("|> ")))
        .when(style == 3, F.concat(F.lit("["), role, F.lit("] ")))
        .otherwise(F.concat(named, F.lit(": ")))
    )
    return F.when((turn > 0) & (F.pmod(F.xxhash64(conv, turn), F.lit(6)) == 0), F.lit("")).otherwise(marked)


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, transcript, truth) from turns, PART_TURNS turn numbers to a part."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    turn, text = F.coalesce("turn", F.lit(0)), F.coalesce("text", F.lit(""))
    initial = F.substring(role, 1, 1)
    truth = F.concat(F.upper(initial), F.repeat(initial, F.size(F.split(text, "\n")) - 1))
    rows = conversations.select(
        "conv_id", F.floor(turn / PART_TURNS).alias("part"),
        F.struct(
            turn.alias("turn"), role.alias("role"), F.concat(_prefix(F.col("conv_id"), turn, role), text).alias("line"),
            truth.alias("truth")
        ).alias("x")
    )
    grouped = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return grouped.select(
        "conv_id", "part", F.array_join(F.transform("x", lambda x: x.line), "\n").alias("transcript"),
        F.array_join(F.transform("x", lambda x: x.truth), "").alias("truth")
    )


def recovered(conversations: DataFrame) -> DataFrame:
    """Makes a transcript of every conversation, learns from two thirds and parses all:
    (conv_id, held_out, n_lines, n_right, n_turns, turns_right, rendered_bytes); turns_right counts the lines that begin a turn and are found to, by the right role."""
    made = written(transcripts_of(conversations), "transcripts")
    fold = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(3))
    model = fit(made.where(fold != 1))
    out = parse_parts(made, model)
    at = F.sequence(F.lit(1), F.length("truth"))
    letter = lambda name, i: F.substr(name, i, F.lit(1))
    right = F.size(F.filter(at, lambda i: F.lower(letter("truth", i)) == F.lower(letter("states", i))))
    begun = F.size(F.filter(at, lambda i: letter("truth", i).rlike("[A-Z]") & (letter("truth", i) == letter("states", i))))
    turns = F.length(F.regexp_replace("states", "[a-z]", ""))
    out = out.select(
        "conv_id", F.length("truth").alias("n_lines"), right.alias("n_right"), turns.alias("n_turns"), begun.alias("turns_right"),
        F.octet_length("rendered").alias("rendered_bytes")
    )
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_lines", "n_right", "n_turns", "turns_right", "rendered_bytes")]
    return out.groupBy("conv_id").agg(*sums).select(
        "conv_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "n_lines", "n_right", "n_turns", "turns_right", "rendered_bytes"
    )
