"""Markdown documents as sections, in expressions over the array of a document's lines.

A document is one row throughout, so nothing is shuffled. Its lines are cut at its fences, which gives stretches that
are code or not, then at its headings, which gives sections. A fence of the other kind takes over an open one, so of fences of one
kind in a row every odd one is open. Heading paths follow from a running fold over the headings alone.
Texts and headings are cleaned as whole strings, line by line through multi-line patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators.sectioning import BLANK, assembled, cut, name_title, plain, replaced

# The marks of Markdown.
FRONT = rf"(?s)\A---{BLANK}*\n(?:(.*?)\n)??(?:---{BLANK}*|{BLANK}*\.\.\.{BLANK}*)(?:\n|\z)"
FRONT_TITLE = rf"""(?idm)^{BLANK}*title{BLANK}*:{BLANK}*["']?(.*?)["']?{BLANK}*$"""
FENCE = rf"^[{X.WS}]*(```|~~~)"
HEADING = rf"(?d)^[{X.WS}]*(#{{1,6}})[{X.WS}]+(.+?)[{X.WS}]*$"
INLINE = (
    (r"(?d)!?\[(.*?)\]\([^)\n]*\)", "$1", ("](",)), (r"`([^`\n]+)`", "$1", ("`",)),
    (r"(?d)(?<!\*)\*\*(.*?)\*\*|__(.*?)__|(?<!\*)\*(.*?)\*|_(.*?)_", "$1$2$3$4", ("*", "_")), (r"<[^>\n]+>", "", ("<",)), (r"\\", "", ("\\",)),
)
BLOCK = (
    (rf"(?dm)^{BLANK}*(?:```|~~~)[^\n]*(?:\n|\z)", "", ("```", "~~~")),
    (rf"(?dm)^{BLANK}*#{{1,6}}{BLANK}+([^{X.WS}](?:[^\n]*?[^{X.WS}])?){BLANK}*$", "$1", ("#",)), (rf"(?dm)^{BLANK}*\p{{Nd}}+\.{BLANK}+", "", (".",)),
    (rf"(?dm)^{BLANK}*[-+*]{BLANK}+", "", ("-", "+", "*")), (rf"(?dm)^{BLANK}*>{BLANK}*", "", (">",)),
)
UNTITLED = "Untitled Document"


def block_text(text: Column) -> Column:
    """A block of Markdown as text; headings, items and quotes lose their marks, in code too, and fences go."""
    return plain(replaced(replaced(text, BLOCK), INLINE))


def with_sections(docs: DataFrame, text_col: str = "text", name_col: str = "name") -> DataFrame:
    """docs without the two columns, with rows: the array of (section_index, section_path, heading, text) of each document.

    Null texts count as empty. Other columns must not have names that begin with an underscore.
    """
    keep = [c for c in docs.columns if c not in (text_col, name_col)]
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n")
    df = docs.select(*keep, F.col(name_col).alias("_name"), X.once(text).alias("_text"))
    front = F.when(F.startswith("_text", F.lit("---")), F.struct(*[F.regexp_extract("_text", FRONT, g).alias(n) for g, n in ((0, "all"), (1, "head"))]))
    df = df.withColumn("_front", X.once(front))
    body = F.substring("_text", F.coalesce(F.length("_front.all"), F.lit(0)) + 1, F.length("_text"))
    given = F.try_element_at(F.regexp_extract_all(F.coalesce("_front.head", F.lit("")), F.lit(FRONT_TITLE), F.lit(1)), F.lit(-1))
    df = df.select(*keep, "_name", given.alias("_given"), X.once(body).alias("_body"))
    df = df.withColumn("_lines", X.once(F.split("_body", "\n", -1)))
    fenced = lambda x: F.contains(x, F.lit("```")) | F.contains(x, F.lit("~~~"))
    marks = F.transform("_lines", lambda x: F.when(fenced(x), F.regexp_extract(x, FENCE, 1)).otherwise(""))
    df = df.withColumn("_marks", X.once(marks))
    fences = F.array_compact(F.transform("_marks", lambda m, i: F.when(m != "", i)))
    kinds = F.array_join(F.transform(F.filter("_marks", lambda m: m != ""), lambda m: F.substring(m, 1, 1)), "")
    runs = F.regexp_extract_all(kinds, F.lit("`+|~+"), F.lit(0))
    opens = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda j: j % 2 == 1)))
    df = df.withColumn("_fences", X.once(fences)).withColumn("_opens", X.once(opens))

    def stretch(k: Column, lines: Column) -> Column:
        code = (k > 0) & F.coalesce(F.get("_opens", k - 1), F.lit(False))
        none = lambda x, j: code | ((k > 0) & (j == 0)) | ~F.contains(x, F.lit("#"))
        level = lambda x, j: F.when(none(x, j), 0).otherwise(F.length(F.regexp_extract(x, HEADING, 1)))
        return F.transform(lines, lambda x, j: F.struct(level(x, j).alias("level"), x.alias("line")))

    df = df.withColumn("_items", X.once(F.flatten(cut(F.col("_lines"), F.col("_fences"), stretch))))
    places = F.array_compact(F.transform("_items", lambda x, i: F.when(x["level"] > 0, i)))
    df = df.withColumn("_places", X.once(places)).drop("_lines", "_marks", "_fences", "_opens")
    # The given title, the one from the name, and the headings' texts are cleaned together.
    raw = F.transform("_places", lambda at: replaced(F.regexp_extract(F.get("_items", at)["line"], HEADING, 2), INLINE))
    lines = F.concat(F.array(F.coalesce("_given", F.lit("")), name_title(F.col("_name"))), raw)
    df = df.withColumn("_clean", X.once(F.transform(lines, lambda t: plain(t))))
    heads = F.transform("_places", lambda at, i: F.struct(F.get("_items", at)["level"].alias("level"), F.get("_clean", i + 2).alias("text")))
    df = df.withColumn("_heads", X.once(heads))
    top = F.get(F.filter("_heads", lambda h: h["level"] == 1), F.lit(0))["text"]
    filled = lambda i: F.nullif(F.get("_clean", F.lit(i)), F.lit(""))
    title = F.coalesce(filled(0), top, filled(1), F.lit(UNTITLED))
    raw = cut(
        F.col("_items"), F.col("_places"),
        lambda k, items: F.array_join(F.transform(F.when(k == 0, items).otherwise(F.slice(items, F.lit(2), F.size(items))), lambda x: x["line"]), "\n")
    )
    df = df.withColumn("_title", X.once(title)).withColumn("_texts", X.once(F.transform(raw, lambda t: block_text(t))))
    return assembled(df, keep, block_text(F.col("_body")))
