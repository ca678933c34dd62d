"""ASN.1 values of certificate files: one pass over tags and lengths with an explicit stack, then what the values say.

Lengths may be definite or, as BER allows, indefinite.  What does not nest, or runs beyond its parent, is no value at all.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType, TimestampType

#: Longest value that is read, most elements in one, and how deep they may lie; real files stay far below.
MOST_BYTES, MOST_ELEMENTS, MOST_DEPTH = 8 << 20, 200_000, 200
SEQUENCE, SET, OID, INTEGER, BITS, EXPLICIT_0 = 0x30, 0x31, 0x06, 0x02, 0x03, 0xA0

# Identifiers of contents, and names of key algorithms and of parts of names.
PKCS7_DATA, PKCS7_SIGNED, PKCS7_ENCRYPTED, SUBJECT_ALT_NAME = "1.2.840.113549.1.7.1", "1.2.840.113549.1.7.2", "1.2.840.113549.1.7.6", "2.5.29.17"
KEY_NAMES = {"1.2.840.113549.1.1.1": "RSA", "1.2.840.10045.2.1": "ECC", "1.2.840.10040.4.1": "DSA"}
NAME_PARTS = {
    "2.5.4.3": "CN", "2.5.4.4": "SN", "2.5.4.5": "SERIALNUMBER", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "S", "2.5.4.9": "STREET", "2.5.4.10": "O", "2.5.4.11": "OU", "2.5.4.12": "T",
    "1.2.840.113549.1.9.1": "E", "0.9.2342.19200300.100.1.25": "DC",
}
FACTS = StructType(
    [StructField(c, StringType()) for c in ("kind", "subject", "issuer")] + [StructField(c, TimestampType()) for c in ("not_before", "not_after")] + [StructField(c, StringType()) for c in ("thumbprint", "key_algorithm")]
    + [StructField(c, BooleanType()) for c in ("self_signed", "san_present")] + [StructField("bundle", ArrayType(StringType()))]
)


@dataclass
class Element:
    """``tag`` is the first byte; the value is ``data[body:stop]``, all of it ``data[start:end]``."""

    tag: int
    start: int
    body: int
    stop: int = -1
    end: int = -1
    kids: list[Element] = field(default_factory=list)


def parse(data: bytes) -> Element | None:
    """The value at the start of ``data`` with all that it holds; None if it is malformed.  What follows it doesn't count."""
    root, open_, at, n = None, [], 0, 0
    while True:
        # what has been filled is complete, and so may be what holds it
        while open_ and open_[-1].stop == at:
            open_.pop().end = at
        if root is not None and not open_:
            return root
        limit = next((e.stop for e in reversed(open_) if e.stop >= 0), len(data))
        if open_ and open_[-1].stop < 0 and data[at : at + 2] == b"\0\0":
            open_[-1].stop, at = at, at + 2
            open_.pop().end = at
            continue
        n += 1
        if at + 2 > limit or n > MOST_ELEMENTS or len(open_) > MOST_DEPTH:
            return None
        one = Element(data[at], at, at + 2)
        if one.tag & 0x1F == 0x1F:  # numbers of several bytes are in none of these formats
            return None
        length = data[at + 1]
        if length == 0x80:
            if not one.tag & 0x20:
                return None
        else:
            if length > 0x80:
                more = length & 0x7F
                one.body += more
                if more > 4 or one.body > limit:
                    return None
                length = int.from_bytes(data[at + 2 : one.body], "big")
            one.stop = one.body + length
            if one.stop > limit:
                return None
        if open_:
            open_[-1].kids.append(one)
        else:
            root = one
        at = one.body
        if one.tag & 0x20:
            open_.append(one)
        else:
            at = one.end = one.stop
            if one is root:
                return root


def oid(data: bytes, e: Element) -> str | None:
    raw = data[e.body : e.stop]
    if e.tag != OID or not raw or raw[-1] & 0x80:
        return None
    numbers, value = [], 0
    for byte in raw:
        value = value << 7 | byte & 0x7F
        if not byte & 0x80:
            numbers.append(value)
            value = 0
    first = min(2, numbers[0] // 40)
    return ".".join(map(str, [first, numbers[0] - 40 * first, *numbers[1:]]))


def _tags(e: Element) -> list[int]:
    return [k.tag for k in e.kids]


def _algorithm(data: bytes, e: Element) -> str | None:
    return oid(data, e.kids[0]) if e.tag == SEQUENCE and e.kids else None


def kind(data: bytes, top: Element | None) -> str | None:
    """``p12``, ``p7b`` or ``cer``."""
    if top is None or top.tag != SEQUENCE:
        return None
    tags = _tags(top)
    if tags[:2] == [INTEGER, SEQUENCE] and len(tags) <= 3:
        safe = top.kids[1]
        version = int.from_bytes(data[top.kids[0].body : top.kids[0].stop], "big", signed=True)
        if version == 3 and _tags(safe) == [OID, EXPLICIT_0] and oid(data, safe.kids[0]) in (PKCS7_DATA, PKCS7_ENCRYPTED):
            return "p12"
    if tags == [OID, EXPLICIT_0] and oid(data, top.kids[0]) == PKCS7_SIGNED:
        return "p7b"
    return "cer" if _body(data, top) else None


def kind_of(data: bytes) -> str | None:
    """``kind`` of the value that ``data`` begins with."""
    return kind(data, parse(data))


def _body(data: bytes, top: Element) -> list[Element] | None:
    """Serial number, algorithm, issuer, validity, subject, key and extensions of a certificate; None if it is none."""
    if _tags(top) != [SEQUENCE, SEQUENCE, BITS] or top.kids[2].stop - top.kids[2].body < 2:
        return None
    parts = top.kids[0].kids
    parts = parts[1:] if parts and parts[0].tag == EXPLICIT_0 else parts
    if [p.tag for p in parts[:6]] != [INTEGER, *[SEQUENCE] * 5] or any(p.tag & 0xC0 != 0x80 or not 1 <= p.tag & 0x1F <= 3 for p in parts[6:]):
        return None
    inner, outer = _algorithm(data, parts[1]), _algorithm(data, top.kids[1])
    return parts if inner and inner == outer else None


def _string(data: bytes, e: Element) -> str:
    return data[e.body : e.stop].decode({0x1E: "utf-16-be", 0x1C: "utf-32-be", 0x14: "latin-1"}.get(e.tag, "utf-8"), "replace")


def name(data: bytes, e: Element) -> str:
    """A distinguished name, its last part first, values with separators in quotes."""
    out = []
    for group in reversed(e.kids):
        pairs = []
        for pair in group.kids:
            if len(pair.kids) == 2:
                key, value = oid(data, pair.kids[0]) or "", _string(data, pair.kids[1])
                quoted = '"' + value.replace('"', '""') + '"' if any(c in value for c in ',+="\n<>#;') or value != value.strip() else value
                pairs.append(f"{NAME_PARTS.get(key, f'OID.{key}')}={quoted}")
        out.append(" + ".join(pairs))
    return ", ".join(out)


def moment(data: bytes, e: Element) -> datetime | None:
    """A UTCTime (years 1950 to 2049) or GeneralizedTime; None if it is malformed."""
    text = data[e.body : e.stop].decode("ascii", "replace")
    if e.tag == 0x17 and text[:2].isdigit():
        text = ("19" if text[:2] >= "50" else "20") + text
    digits = text.rstrip("Z")
    zone = timedelta()
    if len(text) > 5 and text[-5] in "+-" and text[-4:].isdigit():
        zone = timedelta(hours=int(text[-4:-2]), minutes=int(text[-2:])) * (1 if text[-5] == "+" else -1)
        digits = text[:-5]
    digits = digits.split(".")[0]
    try:
        return datetime.strptime(digits, {10: "%Y%m%d%H", 12: "%Y%m%d%H%M"}.get(len(digits), "%Y%m%d%H%M%S")).replace(tzinfo=UTC) - zone
    except (ValueError, OverflowError):
        return None


def certificate(data: bytes, top: Element) -> dict | None:
    """What a certificate says of itself."""
    parts = _body(data, top)
    if parts is None:
        return None
    times = [moment(data, t) for t in parts[3].kids] + [None, None]
    algorithm = _algorithm(data, parts[5].kids[0]) if parts[5].kids else None
    extensions = [x.kids[0] for p in parts[6:] if p.tag == 0xA3 for s in p.kids for x in s.kids if x.kids]
    subject, issuer = name(data, parts[4]), name(data, parts[2])
    return {
        "subject": subject, "issuer": issuer, "not_before": times[0], "not_after": times[1], "thumbprint": hashlib.sha1(data[top.start : top.end]).hexdigest().upper(),
        "key_algorithm": KEY_NAMES.get(algorithm, algorithm), "self_signed": subject.lower() == issuer.lower(), "san_present": any(oid(data, x) == SUBJECT_ALT_NAME for x in extensions),
    }


def bundle(data: bytes, top: Element) -> list[str]:
    """Subjects of the certificates of signed data."""
    signed = top.kids[1].kids[0] if top.kids[1].kids else None
    found = [c for k in (signed.kids if signed else []) if k.tag == EXPLICIT_0 for c in k.kids if c.tag == SEQUENCE]
    bodies = [b for b in (_body(data, c) for c in found) if b]
    return [name(data, b[4]) for b in bodies]


def facts(data: bytes) -> dict | None:
    """The fields of ``FACTS``; None for what is no such file."""
    if len(data) > MOST_BYTES or data[:1] != b"\x30":
        return None
    top = parse(data)
    what = kind(data, top)
    if what is None:
        return None
    return {"kind": what, **((certificate(data, top) or {}) if what == "cer" else {}), "bundle": bundle(data, top) if what == "p7b" else None}


@F.pandas_udf(FACTS)
def der_facts(content: pd.Series) -> pd.DataFrame:
    """``facts`` of whole contents; null for null, for other contents and for malformed ones."""
    found = [None if c is None else facts(c) for c in content]
    out = pd.DataFrame({c: pd.Series([f.get(c) if f else None for f in found], dtype=object) for c in FACTS.names})
    for c in ("not_before", "not_after"):
        naive = [t.replace(tzinfo=None) if t else None for t in out[c]]
        out[c] = pd.Series(np.array(naive, "datetime64[us]")).dt.tz_localize("UTC")
    return out


def pem_body(text: Column) -> Column:
    """The bytes of the first certificate that a text holds in PEM; null if it holds none."""
    block = F.regexp_extract(text, "(?is)-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", 1)
    return F.try_to_binary(F.nullif(F.regexp_replace(block, "\\s", ""), F.lit("")), F.lit("base64"))


def name_part(name: Column, part: str) -> Column:
    """A part of a distinguished name, such as ``CN``, by splitting at commas; the first counts, null if there is none."""
    found = F.filter(F.split(name, ","), lambda x: F.lower(F.trim(F.split_part(x, F.lit("="), F.lit(1)))) == part.lower())
    first = F.get(found, 0)
    return F.when(F.locate("=", first) > 0, F.trim(first.substr(F.locate("=", first) + 1, F.length(first))))
