"""Character references of HTML resolved natively; what they stand for comes from the standard library's table."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference by number or name, or else text without any.
_PIECE = r"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
_LAST = 0x10FFFF
#: Names that count without a semicolon, too, the longest first.
_OPEN = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
#: What numbers below 256 stand for that are no such character.
_LOW = {str(n): html.unescape(f"&#{n};") for n in range(256) if html.unescape(f"&#{n};") != chr(n)}


def _table(entries: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _numbered(piece: Column) -> Column:
    base = F.when(piece.rlike("^&#[xX]"), 16).otherwise(10)
    digits = F.regexp_extract(piece, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    number = F.when(digits == "", 0).when(F.length(digits) > 7, _LAST + 1).otherwise(
        F.when(base == 16, F.conv(F.when(base == 16, digits).otherwise("0"), 16, 10)).otherwise(F.when(base == 10, digits)).cast("long")
    )
    wrong = (number > _LAST) | number.between(0xD800, 0xDFFF)
    nothing = number.between(0xFDD0, 0xFDEF) | (number % 0x10000 >= 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.coalesce(
        F.try_element_at(_table(_LOW), number.cast("string")), F.when(wrong, "�").when(nothing, "").otherwise(char)
    )


def _named(piece: Column, table: Column) -> Column:
    name = F.substring(piece, 2, 64)
    begin = F.regexp_extract(name, f"^(?:{_OPEN})", 0)
    longest = F.when(begin != "", F.concat(F.try_element_at(table, begin), F.substring(name, F.length(begin) + 1, F.lit(64))))
    return F.coalesce(F.try_element_at(table, name), longest, piece)


def unescaped(text: Column) -> Column:
    """text with every character reference replaced, as browsers do; others stay as they are."""
    piece = lambda p, m: F.when(p.rlike("^&#[0-9xX]"), _numbered(p)).when(p.startswith("&"), _named(p, m)).otherwise(p)
    pieces = lambda m: F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), lambda p: piece(p, m))
    # The table stands in the plan once, whatever refers to it.
    whole = F.get(F.transform(F.array(_table(html5)), lambda m: F.array_join(pieces(m), "")), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)
