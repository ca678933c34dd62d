"""Queries of the operators that follow structures: directories, certificates, nested contents, files read in ranges.

Their contents are made around the documents' texts (``made``); the SQL states what such contents are by the keys.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import quopri

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compound, containers, der, zipdir
from ..operators import archives, nested
from ..operators import detect as dt
from ..sources import blob, ranged
from . import made
from .queries import _query, _table

_CN, _O, _C = "2.5.4.3", "2.5.4.10", "2.5.4.6"


def _content(key: int, text: bytes) -> bytes:
    """A content of the type whose number is the key's remainder (see ``content_types``)."""
    office = {"[Content_Types].xml": b"<Types/>"}
    issuer = {_C: "PL", _CN: "root"}
    one = made.certificate({_CN: f"doc {key}"}, issuer, "240101000000Z", "300101000000Z")
    makers = [
        lambda: made.executable(0x2002, 2, text), lambda: made.executable(2, 1, text), lambda: made.executable(2, 2, text),
        lambda: made.zipped({**office, "word/document.xml": text}), lambda: made.zipped({**office, "xl/workbook.xml": text}), lambda: made.zipped({"ppt/presentation.xml": text, **office}, stored=False),
        lambda: made.zipped({"META-INF/MANIFEST.MF": text}), lambda: made.zipped({"META-INF/MANIFEST.MF": b"", "classes.dex": text}), lambda: made.zipped({"mimetype": b"application/epub+zip", "a.opf": text}),
        lambda: made.zipped({"a.txt": text, "x/META-INF/MANIFEST.MF": b""}),
        # what an archive only stores doesn't tell its type
        lambda: made.zipped({"a/report.docx": made.zipped({**office, "word/document.xml": text})}), lambda: made.zipped({"lib.jar": made.zipped({"META-INF/MANIFEST.MF": text})}),
        lambda: made.compound({"WordDocument": text, "1Table": b""}), lambda: made.compound({"Workbook": text}), lambda: made.compound({"Current User": b"", "PowerPoint Document": text}, shift=12),
        lambda: made.compound({"__substg1.0_0037001F": text, "__properties_version1.0": b"x"}), lambda: made.compound({"\5SummaryInformation": b"", "Property": text, "Directory": b"", "Media": b""}),
        lambda: made.compound({"\5SummaryInformation": text, "Property": b"", "File": b""}), lambda: made.compound({"Contents": b"WordDocument Workbook " + text}),
        lambda: bytes(0x8001) + b"CD001" + text, lambda: one, lambda: made.signed_data(one, one), lambda: made.key_store(text), lambda: one + b"\0", lambda: one[:-1],
    ]
    return makers[key % len(makers)]()


# What ``_content`` makes: extension, confidence, reason.
_CONTENTS = [
    ("dll", "High", "magic:exe"), ("sys", "High", "magic:exe"), ("exe", "High", "magic:exe"), ("docx", "High", "ooxml:docx"), ("xlsx", "High", "ooxml:xlsx"), ("pptx", "High", "ooxml:pptx"), ("jar", "High", "zip:jar"),
    ("apk", "High", "zip:apk"), ("epub", "High", "zip:epub"), ("zip", "High", "magic:zip"), ("zip", "High", "magic:zip"), ("zip", "High", "magic:zip"), ("doc", "Medium", "ole2:word"), ("xls", "Medium", "ole2:xls"),
    ("ppt", "Medium", "ole2:ppt"), ("msg", "Medium", "msg:ole"), ("msi", "High", "ole2:msi-cfbf-high"), ("msi", "Medium", "ole2:msi-cfbf"), ("ole2", "High", "magic:ole2"), ("iso", "High", "iso:cd001"),
    ("cer", "Low", "asn1:der-cert"), ("p7b", "Low", "asn1:pkcs7-signed-data"), ("p12", "Low", "asn1:pkcs12"), ("cer", "Low", "asn1:der-cert"), (None, None, None),
]


def _listed(i: int) -> str:
    return ", ".join("null" if c[i] is None else f"'{c[i]}'" for c in _CONTENTS)


@_query(
    f"""with c as (select doc_id, cast(doc_id % {len(_CONTENTS)} + 1 as integer) n from documents)
select doc_id, list_extract([{_listed(0)}], n) extension, list_extract([{_listed(1)}], n) confidence, list_extract([{_listed(2)}], n) reason, n in (1, 2, 3, 17, 18) is_dangerous, n in (1, 3) is_executable from c"""
)
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of contents around every document's text that their leading bytes don't tell."""
    found = dt.detect(blob.column(made.contents(_table(spark, sf_dir, "documents"), _content), "doc_id", "content"))
    return found.select(F.col("id").cast("long").alias("doc_id"), "extension", "confidence", "reason", "is_dangerous", (F.col("kind") == "Executable").alias("is_executable"))


def _office_file(key: int, text: bytes) -> bytes:
    streams = {"WordDocument": text} | {f"Stream{i}": b"s" for i in range(key % 23)}
    return made.compound(streams, ("Macros", "VBA") if key % 3 == 0 else ("ObjectPool",), 12 if key % 2 else 9)


@_query(
    """select doc_id, cast(doc_id % 23 + case when doc_id % 3 = 0 then 4 else 3 end as integer) n_entries, cast(octet_length(encode(coalesce(text, ''))) as bigint) main_bytes, doc_id % 3 = 0 has_macros from documents"""
)
def office_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an OLE file around every document's text: their number, the length of the main stream, whether macros are among them."""
    files = blob.column(made.contents(_table(spark, sf_dir, "documents"), _office_file), "doc_id", "content")
    listed = archives.with_directory(files).withColumn("main", F.get(F.filter("directory", lambda e: e["name"] == "WordDocument"), 0))
    names = F.struct(F.transform("directory", lambda e: e["name"]).alias("names"))
    return listed.select(F.col("id").cast("long").alias("doc_id"), F.size("directory").alias("n_entries"), F.col("main.size").alias("main_bytes"), containers.has_macros(names).alias("has_macros"))


def _certified(key: int, text: bytes) -> bytes:
    issuer = {_C: "PL", _O: "Root, Inc", _CN: "root"}
    subject = issuer if key % 5 == 0 else {_C: "PL", _O: "Docs", _CN: f"doc {key}"}
    one = made.certificate(subject, issuer, f"{key % 100:02d}0102030405Z", f"{2050 + key % 50}0607080910Z", "a.example" if key % 2 else None)
    if key % 4 == 3:
        return b"text before\n-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(one) + b"-----END CERTIFICATE-----\n" + text
    return made.signed_data(one, one) if key % 4 == 2 else one


@_query(
    """with k as (select doc_id, doc_id % 4 = 2 bundled, case when doc_id % 5 = 0 then 'CN=root, O="Root, Inc", C=PL' else 'CN=doc ' || doc_id || ', O=Docs, C=PL' end subject, case when doc_id % 100 >= 50 then 1900 else 2000 end + doc_id % 100 y from documents)
select doc_id, case when bundled then 'p7b' else 'cer' end kind, case when not bundled then subject end subject, case when not bundled then 'root' end issuer_name, case when not bundled then make_timestamp(y, 1, 2, 3, 4, 5) end not_before,
case when not bundled then 2050 + doc_id % 50 end last_year, case when not bundled then 'RSA' end key_algorithm, case when not bundled then doc_id % 5 = 0 end self_signed, case when not bundled then doc_id % 2 = 1 end san_present,
case when bundled then [subject, subject] end bundle from k"""
)
def certificate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a certificate made for every document says: in DER, in PEM before the text, or bundled as signed data."""
    files = made.contents(_table(spark, sf_dir, "documents"), _certified)
    body = F.coalesce(der.pem_body(F.decode(F.substring("content", 1, 1 << 16), "iso-8859-1")), F.col("content"))
    c = files.select("doc_id", der.der_facts(body).alias("c"))
    utc = F.to_timestamp_ntz(F.date_format("c.not_before", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return c.select(
        "doc_id", "c.kind", "c.subject", der.name_part(F.col("c.issuer"), "CN").alias("issuer_name"), utc.alias("not_before"), F.year("c.not_after").cast("long").alias("last_year"), "c.key_algorithm", "c.self_signed", "c.san_present", "c.bundle",
    )


def _packed(key: int, text: bytes) -> bytes:
    program = made.executable(2, 2, bytes(range(128, 256)) + text[:400].replace(b"<", b" ")) * 2
    makers = [
        lambda: base64.b64encode(program), lambda: base64.encodebytes(gzip.compress(program, 0)), lambda: binascii.hexlify(program), lambda: base64.a85encode(program, adobe=True),
        lambda: b"begin 644 a.exe\n" + b"".join(binascii.b2a_uu(program[i : i + 45]) for i in range(0, len(program), 45)) + b"`\nend\n",
        lambda: b"Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring(b"\x89PNG\r\n\x1a\n" + program, quotetabs=True),
        lambda: made.zipped({"in.zip": made.zipped({"run.exe": program, "note.bin": b"\0\1"}, stored=False)}), lambda: gzip.compress(made.tarred({"a/b.zip": made.zipped({"c.docx": made.zipped({"[Content_Types].xml": b"", "word/document.xml": b'<?xml version="1.0"?>' + text})})})),
        lambda: text[:0] + b"\0\1\2" * 50,
    ]
    return makers[key % len(makers)]()


# What ``_packed`` makes.
_NESTED = ["enc:b64,enc:det:exe", "enc:b64,enc:det:exe", "enc:det:exe,enc:hex", "enc:b85,enc:det:exe", "enc:det:exe,enc:uu", "enc:det:,enc:qp", "nested:exe,nested:zip", "nested:docx,nested:tar,nested:xml,nested:zip", None]


@_query(f"""select doc_id, f findings, case n when 6 then 2 when 7 then 4 when 8 then 0 else 1 end deepest from (select doc_id, doc_id % {len(_NESTED)} n, list_extract([{", ".join("null" if x is None else f"'{x}'" for x in _NESTED)}], cast(doc_id % {len(_NESTED)} + 1 as integer)) f from documents)""")
def nested_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in encoded texts and archives in archives, made around every document's text, and how deep it lies."""
    files = blob.column(made.contents(_table(spark, sf_dir, "documents"), _packed), "doc_id", "content")
    opened = nested.unwrap(files)
    deepest = opened.where("extension is not null or via is not null").groupBy("id").agg(F.max(F.when((F.col("extension").isNotNull()) | (F.col("depth") == 1), F.col("depth"))).alias("deepest"))
    ids = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    found = ids.join(nested.nested_findings(opened), "id", "left").join(deepest, "id", "left")
    return found.select("doc_id", F.array_join("findings", ",").alias("findings"), F.coalesce("deepest", F.lit(0)).alias("deepest"))
