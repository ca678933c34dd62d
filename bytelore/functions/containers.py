"""Types that the leading bytes alone don't tell: disk images, and what ZIP, OLE and JSON contents hold.

What stands at fixed places is read by expressions.  Directories of ZIP and OLE files are followed by small readers
(``look_inside``), over whole contents or over ranges of a file; what their names mean is expressions again.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import compound, der, zipdir

#: Where volume descriptors begin, and the bytes of 32 of them.
VOLUME_AT, VOLUME_BYTES, TAIL_BYTES = 0x8000, 32 * 2048, 512


def type_struct(ext: str, mime: str, confidence: str, reason: Column | str) -> Column:
    return F.struct(F.lit(ext).alias("ext"), F.lit(mime).alias("mime"), F.lit(confidence).alias("confidence"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def disk_image(volume: Column, tail: Column) -> Column:
    """UDF, ISO 9660 or a UDIF trailer; null for others.  ``volume``, ``tail``: bytes from ``VOLUME_AT`` on and the last ones."""
    at = lambda offset: F.decode(F.substring(volume, offset - VOLUME_AT + 1, 5), "iso-8859-1")
    ids = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.decode(volume.substr(i * 2048 + 2, F.lit(5)), "iso-8859-1"))  # volume descriptors
    place = lambda name: F.array_position(ids, name)
    nsr, begin, end = F.greatest(place("NSR02"), place("NSR03")), place("BEA01"), place("TEA01")
    version = F.when(place("NSR02") > place("NSR03"), "udf:nsr02").otherwise("udf:nsr03")
    iso = reduce(lambda a, b: a | b, (at(offset) == "CD001" for offset in (0x8001, 0x8801, 0x9001)))
    trailer = (F.octet_length(tail) == TAIL_BYTES) & (F.decode(F.substring(tail, 1, 4), "iso-8859-1") == "koly")
    found = (
        F.when((nsr > 0) & (begin > 0) & (begin < nsr) & (end > nsr), type_struct("udf", "application/udf", "High", F.concat(version, F.lit(":bea+tea"))))
        .when(nsr > 0, type_struct("udf", "application/udf", "Medium", version))
        .when(iso, type_struct("iso", "application/x-iso9660-image", "High", "iso:cd001"))
    )
    return F.coalesce(F.when(F.octet_length(volume) > 5, found), F.when(trailer, type_struct("dmg", "application/x-apple-diskimage", "Medium", "udif:koly")))


# Entries that tell a ZIP's type, in the order in which they are tried, and document types by the text of ``mimetype``.
OFFICE = [("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml")]
OFFICE_MIME = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
BY_MIMETYPE = {
    "epub": "application/epub+zip", "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation", "odg": "application/vnd.oasis.opendocument.graphics",
}


#: Bytes of a ``mimetype`` entry that are read, and entries beyond which a ZIP keeps its plain type.
MIMETYPE_BYTES, MOST_ENTRIES = 256, 100_000
#: Longest file that is looked at as a certificate or a bundle of them.
DER_BYTES = 1 << 19
INSIDE = StructType([StructField("names", ArrayType(StringType())), StructField("mimetype", StringType()), StructField("der", StringType())])


def look_inside(read: zipdir.Read, size: int) -> dict | None:
    """Names of a ZIP's entries, with the text of its ``mimetype``, or of an OLE file's, or what a DER value is; None for others."""
    first = read(0, 2)
    if first[:1] == b"\x30":
        what = der.kind_of(read(0, DER_BYTES)) if size <= DER_BYTES else None
        return {"names": None, "mimetype": None, "der": what} if what else None
    if first == b"PK":
        found = zipdir.entries(read, size)
        if found is None:
            return None
        own = next((e for e in found if e.name == "mimetype"), None)
        raw = zipdir.body(read, own, MIMETYPE_BYTES) if own else None
        return {"names": [e.name for e in found[: MOST_ENTRIES + 1]], "mimetype": None if raw is None else raw.decode("utf-8", "replace").strip(), "der": None}
    ole = compound.entries(read, size)
    return None if ole is None else {"names": [e.name for e in ole], "mimetype": None, "der": None}


@F.pandas_udf(INSIDE)
def inside(content: pd.Series) -> pd.DataFrame:
    """``look_inside`` of whole contents; null for null."""
    found = [None if c is None else look_inside(zipdir.reader(c), len(c)) for c in content]
    return pd.DataFrame({k: [None if f is None else f[k] for f in found] for k in INSIDE.names})


def zip_type(found: Column) -> Column:
    """The type that the entries of a ZIP (``inside``) tell; null for a plain one."""
    names = found["names"]
    has = lambda name: F.array_contains(names, name)
    some = lambda test: F.exists(names, test)
    office = [(has("[Content_Types].xml") & has(part), ext, OFFICE_MIME[ext], f"ooxml:{ext}") for ext, part in OFFICE]
    rules = [
        (has("AndroidManifest.xml") | has("classes.dex"), "apk", "application/vnd.android.package-archive"),
        (has("META-INF/MANIFEST.MF"), "jar", "application/java-archive"),
        (some(lambda n: n.startswith("Payload/")) & some(lambda n: n.contains(".app/Info.plist")), "ipa", "application/zip"),
        (has("AppxManifest.xml") & has("AppxSignature.p7x"), "msix", "application/zip"),
        (has("AppxManifest.xml"), "appx", "application/zip"),
        *((found["mimetype"] == mime, ext, mime) for ext, mime in BY_MIMETYPE.items()),
        (has("doc.kml"), "kmz", "application/vnd.google-earth.kmz"),
        (has("extension.vsixmanifest"), "vsix", "application/zip"),
        (has("AppManifest.xaml"), "xap", "application/x-silverlight-app"),
        (some(lambda n: F.lower(n).endswith(".nuspec")), "nupkg", "application/zip"),
    ]
    guessed = F.coalesce(*(F.when(test, type_struct(ext, mime, "High", f"zip:{ext}")) for test, ext, mime in rules))
    return F.coalesce(*(F.when(test, type_struct(ext, mime, "High", reason)) for test, ext, mime, reason in office), F.when(F.size(names) <= MOST_ENTRIES, guessed))


# Entries of OLE files that tell their type; an installer's tables.
OLE_STREAMS = [
    ("doc", "worddocument", "application/msword", "ole2:word"), ("xls", "workbook", "application/vnd.ms-excel", "ole2:xls"),
    ("ppt", "powerpoint document", "application/vnd.ms-powerpoint", "ole2:ppt"),
]
INSTALLER_TABLES = ["property", "directory", "feature", "media", "component", "file", "installexecutesequence"]


def ole_type(found: Column) -> Column:
    """The type that the entries of an OLE file (``inside``) tell; null if they tell none."""
    names = F.transform(found["names"], lambda n: F.lower(n))
    tables = F.size(F.filter(names, lambda n: n.isin(INSTALLER_TABLES)))
    installer = F.exists(names, lambda n: n.contains("summaryinformation"))
    message = F.exists(names, lambda n: n.startswith("__substg1.0_") | (n == "__properties_version1.0"))
    return F.coalesce(
        F.when(message, type_struct("msg", "application/vnd.ms-outlook", "Medium", "msg:ole")),
        *(F.when(F.array_contains(names, name), type_struct(ext, mime, "Medium", reason)) for ext, name, mime, reason in OLE_STREAMS),
        F.when(installer & (tables >= 3), type_struct("msi", "application/x-msi", "High", "ole2:msi-cfbf-high")),
        F.when(installer & (tables == 2), type_struct("msi", "application/x-msi", "Medium", "ole2:msi-cfbf")),
    )


def der_type(found: Column) -> Column:
    """The type of a DER value (``inside``); null for others."""
    kinds = [("p12", "application/x-pkcs12", "asn1:pkcs12"), ("p7b", "application/pkcs7-mime", "asn1:pkcs7-signed-data"), ("cer", "application/pkix-cert", "asn1:der-cert")]
    return F.coalesce(*(F.when(found["der"] == ext, type_struct(ext, mime, "Low", reason)) for ext, mime, reason in kinds))


def has_macros(found: Column) -> Column:
    """Whether an OLE file's entries (``inside``) belong to a VBA project."""
    return F.coalesce(F.exists(found["names"], lambda n: F.lower(n).contains("vba") | (F.lower(n) == "dir")), F.lit(False))


def trace_log(head: Column) -> Column:
    """An event trace by its magic, which is that of event logs cut short, or by the fields of its first buffer's header."""
    digits = F.hex(F.substring(head, 1, 64))
    number = lambda at: F.conv(F.concat(*(F.substring(digits, 2 * (at + i) + 1, 2) for i in (3, 2, 1, 0))), 16, 10).cast("long")
    zeros = F.size(F.filter(F.regexp_extract_all(F.substring(digits, 17, 80), F.lit("(..)"), F.lit(1)), lambda b: b == "00"))
    size, version = number(0), number(4)
    structured = (F.length(digits) == 128) & size.between(1024, 1 << 20) & (size % 1024 == 0) & version.between(0x100, 0x400) & (number(0x30) != 0) & (zeros >= 28)
    magic = digits.startswith("456C6646") & ~digits.startswith("456C6646696C6500")
    return F.when(magic | structured, type_struct("etl", "application/octet-stream", "Medium", "etl:magic"))


def gltf_type(text: Column) -> Column:
    """A glTF scene in JSON; null for other JSON."""
    head = F.lower(F.substring(text, 1, 8192))
    scene = head.contains('"asset"') & head.contains('"version"') & (head.contains('"scenes"') | head.contains('"nodes"'))
    return F.when(scene, type_struct("gltf", "model/gltf+json", "Medium", "gltf:json"))


def head_text(head: Column, limit: int) -> Column:
    """The text of leading bytes: by its byte order mark, as UTF-16 where every other byte is mostly zero, else as UTF-8.

    A UTF-8 character that the end of a full head (``limit`` bytes) cuts off is left out; bytes that are no text give null.
    Halves of surrogate pairs become question marks, zeros go.
    """
    digits, n, raw = F.hex(F.substring(head, 1, 3)), F.octet_length(head), F.decode(head, "iso-8859-1")

    def wide(start: int, charset: str, high: int) -> Column:
        """Two bytes a unit from byte ``start`` on; ``high``: where a unit's high byte is.  Surrogates, which may be cut, are replaced."""
        units = raw.substr(F.lit(start + 1), F.floor((n - start) / 2).cast("int") * 2)
        plain, half = ("[^\\xD8-\\xDF].", "[\\xD8-\\xDF].") if high == 0 else (".[^\\xD8-\\xDF]", ".[\\xD8-\\xDF]")
        safe = F.regexp_replace(units, rf"(?s)\G((?:{plain})*+){half}", "$1" + ("\x00?" if high == 0 else "?\x00"))
        return F.decode(F.encode(safe, "iso-8859-1"), charset)

    half = lambda parity: F.regexp_replace(raw, "(?s)(.)(.)", f"${parity + 1}")
    zeros = lambda parity: F.length(half(parity)) - F.length(F.translate(half(parity), "\x00", ""))
    mostly = lambda parity: F.when((n >= 8) & raw.contains("\x00"), (zeros(parity) * 10 >= n * 4) & (zeros(1 - parity) * 20 < n)).otherwise(False)
    whole = F.try_validate_utf8(head.cast("string"))
    cut = F.coalesce(whole, *(F.when(n == limit, F.try_validate_utf8(head.substr(F.lit(1), n - k).cast("string"))) for k in (1, 2, 3)))
    decoded = (
        F.when(digits.startswith("EFBBBF"), F.coalesce(*(F.try_validate_utf8(head.substr(F.lit(4), n - 3 - k).cast("string")) for k in range(4))))
        .when(digits.startswith("FFFE"), wide(2, "UTF-16LE", 1)).when(digits.startswith("FEFF"), wide(2, "UTF-16BE", 0))
        .when(mostly(1), wide(0, "UTF-16LE", 1)).when(mostly(0), wide(0, "UTF-16BE", 0)).otherwise(cut)
    )
    return F.translate(decoded, "\x00", "")
