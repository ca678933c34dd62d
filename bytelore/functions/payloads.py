"""Encoded payloads and structure checks of text."""

from __future__ import annotations

import json
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LEAST_RUN, LEAST_HEX = 128, 160


def _longest(runs: Column) -> Column:
    return F.get(F.array_sort(runs, lambda a, b: F.length(b) - F.length(a)), 0)


def base64_payload(text: Column) -> Column:
    """The bytes of an armoured block, else of the longest run of base64 letters, url-safe or not; null if it is short or broken."""
    armoured = F.regexp_extract(text, r"(?s)-----BEGIN [^\n]*\n(.*?)-----END ", 1)
    flat = F.translate(text, "-_\r\n\t", "+/")
    run = _longest(F.regexp_extract_all(flat, F.lit(f"[A-Za-z0-9+/]{{{LEAST_RUN},}}={{0,2}}"), F.lit(0)))
    core = F.when(armoured != "", F.regexp_replace(F.translate(armoured, "-_", "+/"), "[^A-Za-z0-9+/=]", "")).otherwise(run)
    bare = F.rtrim(core, F.lit("="))
    return F.try_to_binary(F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)))), F.lit("base64"))


def hex_payload(text: Column) -> Column:
    """The bytes of the longest run of ``LEAST_HEX`` hex digits or more, blanks and line ends aside."""
    run = _longest(F.regexp_extract_all(F.translate(text, " \t\r\n", ""), F.lit(f"[0-9A-Fa-f]{{{LEAST_HEX},}}"), F.lit(0)))
    return F.unhex(F.substring(run, F.lit(1), (F.floor(F.length(run) / 2) * 2).cast("int")))


def _groups(text: Column, size: int) -> Column:
    """A string cut into pieces of ``size`` letters, the last maybe shorter; none of an empty one."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _number(letters: Column, base: int, first: int) -> Column:
    """Letters as digits, the most significant first."""
    digits = F.split(letters, "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda n, c: n * base + (F.ascii(c) - first))


def ascii85_payload(text: Column) -> Column:
    """The bytes between ``<~`` and ``~>``, ``z`` for four zeros; null if there are none or a group is too large."""
    core = F.regexp_extract(text, r"(?s)<~(.*?)~>", 1)
    letters = F.regexp_replace(F.replace(F.regexp_replace(core, r"\s", ""), F.lit("z"), F.lit("!!!!!")), "[^!-u]", "")
    values = F.transform(_groups(letters, 5), lambda g: F.struct(_number(F.rpad(g, 5, "u"), 85, 33).alias("value"), (2 * F.length(g) - 2).alias("kept")))
    digits = F.transform(values, lambda v: F.when(v["value"] < 2**32, F.substring(F.lpad(F.hex(v["value"]), 8, "0"), F.lit(1), v["kept"])))
    return F.when(~F.exists(digits, lambda d: d.isNull()), F.unhex(F.nullif(F.array_join(digits, ""), F.lit(""))))


def uu_payload(text: Column) -> Column:
    """The bytes of the lines after ``begin`` up to ``end``; null if there are none."""
    body = F.regexp_extract(F.translate(text, "\r", ""), r"(?s)(?:^|\n)(?i:begin) [^\n]*\n(.*?)(?:\n(?i:end)(?:\n|$)|$)", 1)
    six = lambda group: F.aggregate(F.split(F.rpad(group, 4, "`"), ""), F.lit(0).cast("long"), lambda n, c: n * 64 + (F.ascii(c) - 32).bitwiseAND(63))
    length = lambda line: (F.ascii(line) - 32).bitwiseAND(63)
    whole = lambda line: F.array_join(F.transform(F.filter(_groups(F.substring(line, F.lit(2), F.length(line)), 4), lambda g: F.length(g) == 4), lambda g: F.lpad(F.hex(six(g)), 6, "0")), "")
    lines = F.transform(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""), lambda x: F.substring(whole(x), F.lit(1), 2 * length(x)))
    return F.unhex(F.nullif(F.array_join(lines, ""), F.lit("")))


def quoted_printable_payload(text: Column) -> Column:
    """The bytes of quoted-printable text: escapes, soft line breaks and all line ends resolved; null if nothing is left."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)=[0-9A-Fa-f]{2}|=\r?\n|[^=\r\n]+|."), F.lit(0))
    narrow = lambda t: F.when(t.rlike("^[\\x00-\\xFF]*$"), F.hex(F.encode(t, "iso-8859-1"))).otherwise(F.hex(F.encode(t, "utf-8")))
    digits = F.transform(tokens, lambda t: F.when(t.rlike("^=[0-9A-Fa-f]{2}$"), F.substring(t, 2, 2)).when(t.rlike("^=?[\r\n]+$"), "").otherwise(narrow(t)))
    return F.unhex(F.nullif(F.array_join(digits, ""), F.lit("")))


#: How each encoded type is told in findings, and decoded.
ENCODED = {"b64": base64_payload, "hex": hex_payload, "b85": ascii85_payload, "uu": uu_payload, "qp": quoted_printable_payload}


def payload(text: Column, kind: Column) -> Column:
    """The bytes that a text of type ``kind`` (``ENCODED``) stands for; null for other kinds and for broken texts."""
    return F.coalesce(*(F.when(kind == k, decode(text)) for k, decode in ENCODED.items()))


def other_payload(text: Column | str, kind: Column | str) -> Column:
    """The bytes of ascii85 (b85), uuencoded (uu) or quoted-printable (qp) text, null if it is broken."""
    text, kind = (F.col(x) if isinstance(x, str) else x for x in (text, kind))
    return F.when(kind.isin("b85", "uu", "qp"), payload(text, kind))


def _reject(x: str) -> None:
    raise ValueError(x)


@F.pandas_udf(StringType())
def json_status(text: pd.Series) -> pd.Series:
    """``passed`` for a JSON object or array without trailing text, NaN or infinities, else ``failed``; null for null."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            if not t.lstrip()[:1] in ("{", "["):
                return "failed"
            json.loads(t, parse_constant=_reject)
            return "passed"
        except (ValueError, RecursionError):
            return "failed"

    return text.map(one)


@F.pandas_udf(StringType())
def xml_status(text: pd.Series) -> pd.Series:
    """``passed`` for well-formed XML without a document type, else ``failed``; null for null."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        parser = expat.ParserCreate()
        parser.StartDoctypeDeclHandler = lambda *_: _reject("doctype")
        try:
            parser.Parse(t.encode(), True)
            return "passed"
        except (expat.ExpatError, ValueError):
            return "failed"

    return text.map(one)


def xml_root(text: Column) -> Column:
    """The local name of the first element, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"^\s*(?:<\?[^>]*\?>\s*|<!--.*?-->\s*|<![^>]*>\s*)*<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)", 1), F.lit(""))
