"""From a document's headings and the texts between them to sections with heading paths and offsets.

Markdown and pages both come here with a row a document: its headings in order, the text before, between and after them,
its title and what to show where there is no such text. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.functions.entities import unescaped

#: White space within a line.
BLANK = rf"[{X.WS}&&[^\n]]"
#: No printed ASCII character follows: quicker to rule out than the class of blanks.
_NONE = "(?![!-~])"


def replaced(text: Column, rules: tuple[tuple, ...]) -> Column:
    """Rules are (pattern, what stands for it, marks); with marks, a text that has none of them has no match of the pattern."""
    for pattern, by, *marks in rules:
        change = lambda t, p=pattern, b=by: F.regexp_replace(t, p, b)
        text = X.where_holding(text, marks[0], change) if marks else change(text)
    return text


def _resolved(text: Column) -> Column:
    return F.replace(X.let(replaced(text, (("\r\n?", "\n", ("\r",)),)), unescaped), F.lit("\xa0"), F.lit(" "))


def _collapsed(text: Column, keep_lines: bool) -> Column:
    edges = rf"(?dm){_NONE}{BLANK}+$" if keep_lines else rf"(?dm){_NONE}(?:^{BLANK}+|{BLANK}+$)"
    text = replaced(text, ((edges, ""), ("[ \t]+", " ", ("  ", "\t"))))
    if not keep_lines:
        text = F.regexp_replace(text, rf"{_NONE}{BLANK}+([,.;:!?])", "$1")
    return X.stripped(replaced(text, (("\n{3,}", "\n\n", ("\n\n\n",)),)))


def plain(text: Column, keep_lines: Column | None = None) -> Column:
    """References resolved, blanks collapsed, one empty line at most; unless lines keep their beginnings, no blank before punctuation."""
    if keep_lines is None:
        return _collapsed(_resolved(text), False)
    either = lambda t: F.when(keep_lines, _collapsed(t, True)).otherwise(_collapsed(t, False))
    return F.get(F.transform(F.array(_resolved(text)), either), F.lit(0))


def section_text(text: Column) -> Column:
    """A cleaned block as a section has it: cleaned once more, with its lines where there are several."""
    return X.let(text, lambda t: plain(t, F.contains(t, F.lit("\n"))))


def name_title(name: Column) -> Column:
    """A title from a file's name: its words, each with a capital."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), "[^/]*$", 0)
    stem = F.regexp_replace(base, r"(?s)(?<=.)\.[^.]*$", "")
    words = F.filter(F.split(stem, "[-_]+"), lambda w: w != "")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    title = F.array_join(F.transform(words, capital), " ")
    return F.when(title == "", stem).otherwise(title)


def running(items: Column, begin: Column, kind: str, step: Callable[[Column, Column], Column], chunk: int = 256) -> Column:
    """What a fold over items has after each: step(state so far, item), from begin; kind is the state's type.

    Results grow chunk by chunk, as appending to one array would copy it for every item.
    """
    whole = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / chunk).cast("int"))
    chunks = F.transform(
        F.when(F.size(items) > 0, whole).otherwise(F.array().cast("array<int>")), lambda c: F.slice(items, c * chunk + 1, F.lit(chunk))
    )

    def fold(before: Column, part: Column) -> Column:
        state = lambda out: F.when(F.size(out) == 0, before).otherwise(F.try_element_at(out, F.lit(-1)))
        return F.aggregate(
            part, F.array().cast(f"array<{kind}>"), lambda out, x: F.concat(out, F.array(step(state(out), x).cast(kind)))
        )

    last = lambda done: F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(-1))
    return F.aggregate(
        chunks, F.array().cast(f"array<array<{kind}>>"),
        lambda done, part: F.concat(done, F.array(fold(F.coalesce(last(done), begin), part))), F.flatten
    )


def cut(items: Column, at: Column, build: Callable[[Column, Column], Column]) -> Column:
    """build(k, items from the k-th place in `at` to the next) for k from 0, where those before the first place are k = 0."""
    begin = lambda k: F.when(k == 0, 0).otherwise(F.get(at, k - 1))
    end = lambda k: F.coalesce(F.get(at, k), F.size(items))
    return F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: build(k, F.slice(items, begin(k) + 1, end(k) - begin(k))))


def assembled(df: DataFrame, keep: list[str], whole: Column) -> DataFrame:
    """The columns `keep` with rows: the array of (section_index, section_path, heading, text) of each document.

    df has _heads, an array of (level, text) of the headings; _texts, the cleaned text before the first and after each, one more;
    _title. whole is the text of the one section of a document that has none of these texts. A heading without text leaves the path as it is.
    """
    df = df.withColumn("_shown", X.once(F.transform(F.concat(F.array("_title"), F.transform("_heads", lambda h: h["text"])), lambda t: plain(t))))
    heads = F.transform("_heads", lambda h, i: F.struct(h["level"], h["text"], F.get("_shown", i + 1).alias("shown")))
    stacks = running(
        heads, F.array().cast("array<string>"), "array<string>",
        lambda stack, head: F.when(head["text"] == "", stack).otherwise(
            F.concat(F.slice(stack, F.lit(1), head["level"] - 1), F.array(head["shown"]))
        )
    )
    df = df.withColumn("_stacks", X.once(stacks))
    none = F.array().cast("array<string>")
    stack = lambda k: F.coalesce(F.when(k > 0, F.get("_stacks", k - 1)), none)
    path = lambda s: _changes(F.filter(F.concat(F.slice("_shown", 1, 1), s), lambda p: p != ""))
    df = df.withColumn("_texts", X.once(F.transform("_texts", lambda t: section_text(t))))
    texts = F.filter(F.transform("_texts", lambda t, k: F.struct(k.alias("k"), t.alias("text"))), lambda s: s["text"] != "")
    found = F.transform(texts, lambda s, i: _row(i, path(stack(s["k"])), F.try_element_at(stack(s["k"]), F.lit(-1)), s["text"]))
    df = df.withColumn("_rows", X.once(found))
    # Read only where no section has a text.
    alone = X.let(section_text(whole), lambda t: F.filter(F.array(_row(F.lit(0), F.array("_title"), F.lit(None).cast("string"), t)), lambda s: s["text"] != ""))
    return df.select(*keep, F.when(F.size("_rows") > 0, F.col("_rows")).otherwise(alone).alias("rows"))


def _row(index: Column, path: Column, heading: Column, text: Column) -> Column:
    return F.struct(index.cast("long").alias("section_index"), path.alias("section_path"), heading.alias("heading"), text.alias("text"))


def _changes(parts: Column) -> Column:
    """Parts without those that equal the one right before."""
    pairs = F.arrays_zip(parts.alias("p"), F.concat(F.array(F.lit(None).cast("string")), parts).alias("q"))
    return F.transform(F.filter(pairs, lambda x: x["p"].isNotNull() & ~x["p"].eqNullSafe(x["q"])), lambda x: x["p"])
