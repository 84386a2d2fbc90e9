"""Text expressions that mean the same in Spark and in the SQL they are checked against."""

from __future__ import annotations

import functools
import operator
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and word classes by code point, and the lexical token pattern.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANKS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]"
SEGMENT = rf"[{WS}]*(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}])"
TERM = r"[A-Za-z0-9]+(?:[._:/-][A-Za-z0-9]+)*"
MARKER = r"\[\d+\]"
BRACKET = r"\[[^\[\]\n]*\]"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def where_holding(text: Column, marks: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """change(text) where text holds one of these marks, else text: finding a mark costs far less than a pattern that needs one."""
    held = lambda t: functools.reduce(operator.or_, [F.contains(t, F.lit(m)) for m in marks])
    return let(text, lambda t: F.when(held(t), change(t)).otherwise(t))


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, rf"[{WS}]+", " "))


def blank(c: Column) -> Column:
    return c.isNull() | (stripped(c) == "")


def found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def once(c: Column) -> Column:
    """A column that is computed once however often it is referred to: projections are merged with what they
    read, but not with a generator's output."""
    return F.explode(F.array(c))


def token_count(c: Column) -> Column:
    return F.size(found(F.coalesce(c, F.lit("")), TOKEN)).cast("long")


def terms(c: Column) -> Column:
    """Lexical terms, A-Z lower-cased; terms are ASCII, so the text may be lower-cased as a whole."""
    return found(F.translate(F.coalesce(c, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), TERM)


def preview(c: Column, n: int) -> Column:
    flat = collapsed(c)
    return F.when(F.length(flat) <= n, flat).otherwise(
        F.concat(F.regexp_replace(F.substring(flat, 1, n - 1), rf"[{WS}]+$", ""), F.lit("…"))
    )


def breadcrumb(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise("(root)")


def request_id(c: Column, most: int = 128) -> Column:
    """A request's id, stripped and cut to `most` characters; one of its own where that is blank."""
    return F.when(blank(c), F.replace(F.uuid(), F.lit("-"), F.lit(""))).otherwise(F.substring(stripped(c), 1, most))
