"""Strings that scripts put together: constant expressions of literals, folded to what they give.

A script becomes tokens, comments aside.  From every string, template, bracket or parenthesis a constant expression is
folded as far as it goes: ``+``, ``.concat(...)``, templates with constant parts, and arrays joined by nothing.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import magic
from .types import let

# Extensions of media types.
MEDIA = {
    "application/javascript": "js", "text/javascript": "js", "application/x-javascript": "js", "text/html": "html", "application/json": "json", "text/json": "json", "application/xml": "xml", "text/xml": "xml",
    "image/svg+xml": "svg", "text/css": "css", "text/plain": "txt", "text/x-powershell": "ps1", "application/x-powershell": "ps1", "text/vbscript": "vbs", "text/x-shellscript": "sh", "application/x-sh": "sh",
}

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|[A-Za-z_$][\w$]*|\s+|.", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)
_QUOTES = ("'", '"', "`")
#: How deep brackets, parentheses and templates may nest.
MOST_DEPTH = 40


def tokens(text: str) -> list[tuple[str, int]]:
    """Tokens and where each ends, without blanks and comments."""
    return [(m.group(), m.end()) for m in _TOKEN.finditer(text) if not m.group().isspace() and not m.group().startswith(("//", "/*"))]


class _Fold:
    """One pass over tokens; ``value`` is what was folded, ``whole`` whether all of the expression was constant."""

    def __init__(self, text: str, depth: int = 0) -> None:
        self.text, self.depth, self.tokens, self.at = text, depth, tokens(text), 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][0] if i < len(self.tokens) else ""

    def take(self, token: str) -> bool:
        if self.peek() != token:
            return False
        self.at += 1
        return True

    def expression(self, depth: int) -> tuple[str, bool]:
        value, whole = self.operand(depth)
        while whole and self.take("+"):
            more, whole = self.operand(depth)
            value += more
        return value, whole

    def operand(self, depth: int) -> tuple[str, bool]:
        token = self.peek()
        if depth > MOST_DEPTH:
            return "", False
        if token == "(":
            self.at += 1
            value, whole = self.expression(depth + 1)
            whole = whole and self.take(")")
        elif token == "[":
            self.at += 1
            value, whole = self.joined(depth + 1)
        elif token[:1] in _QUOTES and len(token) > 1:
            self.at += 1
            value, whole = self.template(token[1:-1], depth + 1) if token[0] == "`" else (_ESCAPE.sub(r"\1", token[1:-1]), True)
        else:
            return "", False
        while whole and self.peek() == "." and self.peek(1) == "concat" and self.peek(2) == "(":
            self.at += 3
            more, whole = self.listed(")", depth + 1)
            value += "".join(more)
        return value, whole

    def listed(self, end: str, depth: int) -> tuple[list[str], bool]:
        out: list[str] = []
        while not self.take(end):
            value, whole = self.expression(depth)
            out.append(value)
            if not whole or not (self.peek() == end or self.take(",")):
                return out, False
        return out, True

    def joined(self, depth: int) -> tuple[str, bool]:
        items, whole = self.listed("]", depth)
        if not whole or not (self.take(".") and self.take("join") and self.take("(")):
            return "", False
        separator = self.peek()
        if separator not in ("''", '""', "``"):  # none at all would be a comma
            return "", False
        self.at += 1
        return "".join(items), self.take(")")

    def template(self, body: str, depth: int) -> tuple[str, bool]:
        value, at = "", 0
        while (begin := body.find("${", at)) >= 0:
            value += _ESCAPE.sub(r"\1", body[at:begin])
            inner = _Fold(body[begin + 2 :], depth)
            more, whole = inner.expression(depth)
            value += more
            if not whole or inner.peek() != "}":
                return value, False
            at = begin + 2 + inner.tokens[inner.at][1]
        return value + _ESCAPE.sub(r"\1", body[at:]), True


def constant_strings(text: str) -> list[str]:
    """What the constant expressions of a script give, in order; of one that isn't constant to its end, what comes before."""
    fold, out = _Fold(text), []
    while fold.at < len(fold.tokens):
        begin = fold.at
        if fold.peek()[:1] in (*_QUOTES, "(", "["):
            value, whole = fold.expression(0)
            if value:
                out.append(value)
            if value and fold.at > begin:
                continue
        fold.at = begin + 1
    return out


@F.pandas_udf(ArrayType(StringType()))
def _data_strings(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [s for s in constant_strings(t) if s[:5].lower() == "data:" and "," in s])


def script_data_uris(text: Column) -> Column:
    """The data addresses that a script's strings give, put together where they are in pieces; null for null.

    Texts without ``data:`` are not looked at.  A string that has the address behind other words is prose.  Make it a
    column before a lambda reads it, as it is worked out outside the engine.
    """
    return F.when(F.lower(text).contains("data:"), _data_strings(F.when(F.lower(text).contains("data:"), text))).when(text.isNotNull(), F.array().cast("array<string>"))


def html_data_uris(text: Column) -> Column:
    """The data addresses in attributes and style sheets of a page; comments and prose aside."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->|/\*.*?\*/", "")
    quoted = F.regexp_extract_all(bare, F.lit(r"""(?i)\s(?:href|src|data|action)\s*=\s*["']\s*(data:[^"'<>]*,[^"'<>]*)"""), F.lit(1))
    plain = F.regexp_extract_all(bare, F.lit(r"""(?i)\s(?:href|src|data|action)\s*=\s*(data:[^"'<>\s]*,[^"'<>\s]*)"""), F.lit(1))
    styled = F.regexp_extract_all(bare, F.lit(r"""(?i)url\(\s*["']?\s*(data:[^"'()<>]*,[^"'()<>]*)"""), F.lit(1))
    return F.transform(F.concat(quoted, plain, styled), F.trim)


def data_payload(uri: Column) -> Column:
    """The bytes of a data address: base64, url-safe or not, or percent-encoded; null if they are broken or none."""
    at = F.locate(",", uri)
    head, rest = F.lower(F.substring(uri, F.lit(1), at - 1)), uri.substr(at + 1, F.length(uri))
    letters = F.rtrim(F.regexp_replace(F.translate(rest, "-_", "+/"), "[^A-Za-z0-9+/=]", ""), F.lit("="))
    packed = F.try_to_binary(F.concat(letters, F.repeat(F.lit("="), F.pmod(-F.length(letters), F.lit(4)))), F.lit("base64"))
    plain = F.encode(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), "utf-8")
    return F.when(at > 0, F.nullif(F.when(head.contains(";base64"), packed).otherwise(plain), F.lit(b"")))


def data_extension(uri: Column) -> Column:
    """The type of a data address: by the leading bytes of its payload, else by its media type; null if neither tells."""
    rules = [r for r in magic.RULES if r.ext != "gpg"]

    def by_header(header: Column) -> Column:
        places = lambda test: reduce(lambda x, y: x & y, (F.substring(header, 2 * o + 1, len(h)) == h for o, h in test))
        return F.coalesce(*(F.when(reduce(lambda x, y: x | y, map(places, r.tests)), F.lit(r.ext)) for r in rules))

    found = let(F.hex(F.substring(data_payload(uri), 1, magic.HEADER)), by_header)
    media = F.trim(F.split_part(F.split_part(F.lower(F.substring(uri, F.lit(6), F.length(uri))), F.lit(","), F.lit(1)), F.lit(";"), F.lit(1)))
    table = F.create_map(*(F.lit(x) for p in MEDIA.items() for x in p))
    return F.coalesce(found, F.try_element_at(table, media))


def data_findings(uris: Column, prefix: str) -> Column:
    """``script:data-uri=2`` and ``script:data-exts=ps1:1,js:1`` (commonest first, at most three); empty where there are none."""
    exts = F.array_compact(F.transform(uris, data_extension))
    counts = F.transform(F.array_distinct(exts), lambda e: F.struct((-F.size(F.filter(exts, lambda x: x == e))).alias("less"), e.alias("ext")))
    top = F.array_join(F.transform(F.slice(F.array_sort(counts), 1, 3), lambda c: F.concat(c["ext"], F.lit(":"), (-c["less"]).cast("string"))), ",")
    n = F.size(uris)
    return F.array_compact(F.array(F.when(n > 0, F.concat(F.lit(f"{prefix}:data-uri="), n.cast("string"))), F.when(top != "", F.concat(F.lit(f"{prefix}:data-exts="), top))))
