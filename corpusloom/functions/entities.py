"""Character references of HTML as column expressions: all named ones, without semicolon too, and numeric ones.

The names come from the standard library's table. A reference is looked up in a literal map by its
first character and name; one that is no name gives its longest beginning that may stand without a
semicolon. Numbers become characters by arithmetic.
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference as browsers cut it, or what stands between references.
PIECES = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
#: Names that need no semicolon, longest first.
BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


@cache
def _names() -> str:
    by_first: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        by_first.setdefault(name[0], {})[name] = value
    return json.dumps(by_first)


def _named(name: Column) -> Column:
    """What a name without its & stands for; null if it is none."""
    names = F.from_json(F.lit(_names()), "map<string,map<string,string>>")
    return F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)


@cache
def _windows() -> dict[int, str]:
    """What numbers of the second control block mean: the characters of code page 1252 where it has one."""
    out = {}
    for n in range(0x80, 0xA0):
        try:
            out[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[n] = chr(n)
    return out


def _character(n: Column) -> Column:
    """The character of a code point, through its four bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numbered(n: Column) -> Column:
    """What a number stands for: code page 1252 for the second control block, nothing for other controls and non-characters."""
    mapped = F.get(F.array(*[F.lit(c) for c in _windows().values()]), (n - 0x80).cast("int"))
    control = n.between(0x1, 0x8) | n.between(0xE, 0x1F) | (n == 0xB) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE)
    broken = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(broken, F.lit("�")).when(n.between(0x80, 0x9F), mapped).when(control, F.lit("")).otherwise(_character(n))


def _number(ref: Column) -> Column:
    """The number of a numeric reference; those of very many digits become one beyond all characters."""
    digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]*);?\z", 1)
    value = F.when(F.substring(ref, 3, 1).isin("x", "X"), F.conv(digits, 16, 10)).otherwise(digits)
    return F.when(F.length(digits) > 8, F.lit(0x110000)).when(digits == "", F.lit(0)).otherwise(value).cast("long")


def _decoded(ref: Column) -> Column:
    name = F.substring(ref, F.lit(2), F.length(ref))
    begin = F.regexp_extract(name, f"^({BARE})", 1)
    rest = F.when(begin == "", ref).otherwise(F.concat(_named(begin), F.substring(name, F.length(begin) + 1, F.length(name))))
    number = F.get(F.transform(F.array(_number(ref)), _numbered), F.lit(0))  # so that the number is taken once
    return F.when(F.startswith(ref, F.lit("&#")), F.when(F.length(ref) > 2, number).otherwise(ref)).otherwise(F.coalesce(_named(name), rest))


def unescape(text: Column) -> Column:
    """The text with its character references decoded."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    decoded = F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("&")) & (p != "&"), _decoded(p)).otherwise(p)), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)
