"""What Office files in ZIP form link to: relationships are inflated alone, their targets are rows of an array."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import zipdir
from ..functions.findings import is_allowed

#: Entries that are inflated, and bytes of each.
PARTS = re.compile(r"(?i)(.*_rels/.*\.rels|.*/document\.xml|document\.xml)")
PART_BYTES = 4 << 20
_PARTS = pa.list_(pa.struct([("name", pa.string()), ("body", pa.string())]))
_PARTS_SQL = "array<struct<name:string,body:string>>"


def with_parts(blobs: DataFrame, content: str = "content") -> DataFrame:
    """``blobs`` with ``entry_names`` and ``parts``: relationships and main documents, inflated; null for contents without a directory."""
    names = blobs.columns
    at = names.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed, parts = [], []
            for x in b.column(at).to_pylist():
                read = zipdir.reader(x or b"")
                found = zipdir.entries(read, len(x)) if x and x[:2] == b"PK" else None
                listed.append(None if found is None else [e.name for e in found])
                chosen = ((e.name, zipdir.body(read, e, PART_BYTES)) for e in found or [] if PARTS.fullmatch(e.name))
                parts.append(None if found is None else [{"name": n, "body": body.decode("utf-8", "replace")} for n, body in chosen if body is not None])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(listed, pa.list_(pa.string())), pa.array(parts, _PARTS)], [*names, "entry_names", "parts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema)
    return blobs.mapInArrow(run, f"{schema}, entry_names array<string>, parts {_PARTS_SQL}")


def link_facts(entry_names: Column, parts: Column, allowed: list[str] = ()) -> Column:
    """``external_links, allowed, disallowed, unc, hosts, flags, findings`` of the columns of ``with_parts``.

    Links are parts of ``xl/externalLinks`` and what the workbook's relationships say of them; targets of those
    relationships on the web count by the list of allowed domains, shares and ``file:`` addresses as ``unc``.
    """
    low = lambda c: F.lower(c)
    linked = F.size(F.filter(entry_names, lambda n: low(n).startswith("xl/externallinks/") & low(n).endswith(".xml")))
    books = F.filter(parts, lambda p: low(p["name"]) == "xl/_rels/workbook.xml.rels")
    others = F.filter(parts, lambda p: low(p["name"]).startswith("xl/externallinks/_rels/") & low(p["name"]).endswith(".rels"))
    pointed = F.aggregate(books, F.lit(0), lambda n, p: n + F.regexp_count(p["body"], F.lit("(?i)externalLinks/")))
    bodies = F.transform(F.concat(books, others), lambda p: p["body"])
    targets = F.transform(F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit('(?i)Target="([^"]*)"'), F.lit(1)))), F.trim)
    web = F.filter(targets, lambda t: low(t).rlike("^(https?:)?//"))
    hosts = F.filter(F.transform(web, lambda t: low(F.regexp_extract(t, r"(?i)^(?:https?:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))), lambda h: h != "")
    permitted = F.size(F.filter(hosts, lambda h: is_allowed(h, list(allowed))))
    unc = F.size(F.filter(targets, lambda t: t.startswith("\\\\") | low(t).startswith("file://")))
    five = F.slice(F.array_distinct(hosts), 1, 5)
    template = F.exists(parts, lambda p: low(p["name"]).endswith("_rels/document.xml.rels") & low(p["body"]).contains("attachedtemplate") & low(p["body"]).rlike(r'targetmode="external"|https?://|\\\\')) | F.exists(
        parts, lambda p: low(p["name"]).endswith("_rels/.rels") & low(p["body"]).contains("attachedtemplate") & low(p["body"]).rlike(r'targetmode="external"|https?://|\\\\')
    )
    dde = F.exists(parts, lambda p: (low(p["name"]) == "document.xml") | low(p["name"]).endswith("/document.xml") & low(p["body"]).rlike("ddeauto| dde "))
    total = linked + pointed
    say = lambda code, n: F.when(n > 0, F.concat(F.lit(f"{code}="), n.cast("string")))
    told = F.array_compact(F.array(say("ooxml:ext-links", total), say("ooxml:ext-allowed", permitted), say("ooxml:ext-disallowed", F.size(hosts) - permitted), say("ooxml:unc", unc), F.when(F.size(five) > 0, F.concat(F.lit("ooxml:hosts="), F.array_join(F.slice(five, 1, 3), ",")))))
    flags = F.array_compact(F.array(F.when(template, "office_remote_template"), F.when(dde, "office_possible_dde"), F.when(total > 0, "office_external_links")))
    return F.struct(
        total.alias("external_links"), permitted.alias("allowed"), (F.size(hosts) - permitted).alias("disallowed"), unc.alias("unc"), five.alias("hosts"), flags.alias("flags"),
        F.when(total > 0, told).otherwise(F.array().cast("array<string>")).alias("findings"),
    )
