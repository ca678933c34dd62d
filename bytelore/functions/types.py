"""Extensions, MIME types, kinds and risk of content types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# MIME type of each extension.
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff",
    "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "7z": "application/x-7z-compressed", "rar": "application/vnd.rar", "tar": "application/x-tar",
    "sqlite": "application/vnd.sqlite3", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ps1": "text/x-powershell", "vbs": "text/vbscript", "psm1": "text/x-powershell", "psd1": "text/x-powershell", "py": "text/x-python", "rb": "text/x-ruby", "lua": "text/x-lua",
    "md": "text/markdown", "cfg": "text/plain", "conf": "text/plain", "sh": "text/x-shellscript", "bash": "text/x-shellscript", "zsh": "text/x-shellscript", "bat": "text/x-batch", "cmd": "text/x-batch",
    "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint", "epub": "application/epub+zip", "jar": "application/java-archive",
    "apk": "application/vnd.android.package-archive", "ipa": "application/zip", "vsix": "application/zip", "xap": "application/x-silverlight-app", "kmz": "application/vnd.google-earth.kmz",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation", "odg": "application/vnd.oasis.opendocument.graphics",
    "parquet": "application/vnd.apache.parquet", "pcap": "application/vnd.tcpdump.pcap", "pcapng": "application/x-pcapng", "flac": "audio/flac", "wasm": "application/wasm", "bz2": "application/x-bzip2",
    "xz": "application/x-xz", "zst": "application/zstd", "ico": "image/x-icon", "mp4": "video/mp4", "m4a": "audio/mp4", "3gp": "video/3gpp", "avi": "video/x-msvideo", "wav": "audio/wav", "mp3": "audio/mpeg",
    "heic": "image/heic", "json": "application/json", "ndjson": "application/x-ndjson", "jsonl": "application/x-ndjson", "xml": "application/xml", "html": "text/html", "toml": "application/toml",
    "csv": "text/csv", "tsv": "text/tab-separated-values", "txt": "text/plain", "log": "text/plain", "qp": "message/quoted-printable", "ini": "text/plain", "inf": "text/plain", "admx": "application/xml",
    "adml": "application/xml", "pol": "application/x-group-policy-registry-pol", "etl": "application/octet-stream",
    "pem": "application/x-pem-file", "crt": "application/pkix-cert", "cer": "application/pkix-cert", "csr": "application/pkcs10", "key": "application/x-pem-key", "pub": "application/x-pem-key",
    "p7b": "application/pkcs7-mime", "spc": "application/x-pkcs7-certificates", "p7s": "application/pkcs7-signature", "p12": "application/x-pkcs12", "pfx": "application/x-pkcs12",
    "asc": "application/pgp", "pgp": "application/pgp-encrypted", "gpg": "application/pgp-encrypted",
}
# Extensions that can run, and those of each kind.
DANGEROUS = "exe dll sys msi msp cpl scr pif com bat cmd ps1 psm1 psd1 vbs js jse wsf wsh reg hta lnk".split()
TEXT = (
    "txt json xml html csv tsv yml yaml ini inf admx adml log rtf eml ndjson jsonl toml "
    "ps1 psm1 psd1 vbs vbe wsf wsh js jse mjs cjs sh bash zsh bat cmd py pyw rb pl lua"
).split()
IMAGE = "png jpg jpeg gif webp bmp tif tiff heic".split()
ARCHIVE = "zip 7z rar tar gz bz2 xz iso".split()
KINDS = {"Executable": "elf exe dll macho".split(), "Document": "docx xlsx pptx pdf rtf eml".split(), "Model": "gltf glb".split(), "Database": ["sqlite"]}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def normalise_extension(ext: Column) -> Column:
    """Lower case without leading dots; null if nothing is left."""
    return F.nullif(F.lower(F.ltrim(F.trim(ext), F.lit("."))), F.lit(""))


def mime_of(ext: Column, found: Column | None = None) -> Column:
    """The type ``found``, unless it is missing or generic and the extension tells better."""
    table = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    known = F.try_element_at(table, ext)
    if found is None:
        return known
    return F.when(F.coalesce(found, F.lit("application/octet-stream")) == "application/octet-stream", F.coalesce(known, found)).otherwise(found)


def is_dangerous(ext: Column, more: tuple[str, ...] = (), replace: bool = False) -> Column:
    """Whether the extension is one that can run; ``more`` adds to the list or replaces it."""
    return F.coalesce(normalise_extension(ext).isin([*more] if replace else [*DANGEROUS, *more]), F.lit(False))


def kind_sql(ext: str, mime: str) -> str:
    """The broad kind of a type, first rule first, as SQL for either engine."""
    among = lambda names: f"{ext} in ({', '.join(repr(x) for x in names)})"
    rules = [
        (f"{mime} like 'text/%' or {among(TEXT)}", "Text"), (f"{mime} like 'image/%' or {among(IMAGE)}", "Image"), (f"{mime} like 'audio/%'", "Audio"), (f"{mime} like 'video/%'", "Video"),
        (f"{mime} like '%zip%' or {mime} like '%tar%' or {among(ARCHIVE)}", "Archive"), *((among(v), k) for k, v in KINDS.items()),
    ]
    return "case " + " ".join(f"when {c} then '{k}'" for c, k in rules) + " else 'Unknown' end"


# Extensions that stand for each other when a declared one is compared with what was found.
FAMILIES = [
    "cer crt", "yml yaml", "jsonl ndjson", "jpg jpeg", "htm html", "ps1 psm1 psd1", "bat cmd", "exe dll sys scr cpl ocx", "txt log cfg conf ini inf md csv tsv", "tif tiff", "gz tgz", "js mjs cjs",
]
# Declared types that are a special case of what was found.
SPECIAL_CASES = {"admx": "xml", "adml": "xml", "msi": "ole2", "doc": "ole2", "xls": "ole2", "ppt": "ole2", "docx": "zip", "xlsx": "zip", "pptx": "zip", "jar": "zip", "apk": "zip", "inf": "ini", "toml": "ini"}


def agrees_sql(declared: str, found: str) -> str:
    """Whether a declared extension fits the one found."""
    family = "case " + " ".join(f"when {{0}} in ({', '.join(repr(x) for x in names.split())}) then {i}" for i, names in enumerate(FAMILIES)) + " else -1 end"
    special = " or ".join(f"({declared} = '{k}' and {found} = '{v}')" for k, v in SPECIAL_CASES.items())
    return f"({declared} = {found} or ({family.format(declared)} >= 0 and {family.format(declared)} = {family.format(found)}) or {special})"
