"""Types by leading bytes: ordered rules over the upper-case hex of a header."""

from __future__ import annotations

from dataclasses import dataclass

from .types import MIME


@dataclass(frozen=True)
class Magic:
    """``tests``: alternatives, each a set of byte offset and hex that all must hold."""

    ext: str
    mime: str
    reason: str
    tests: tuple[tuple[tuple[int, str], ...], ...]
    confidence: str = "High"


def _at(*pairs: tuple[int, str]) -> tuple[tuple[int, str], ...]:
    return pairs


def _ascii(s: str) -> str:
    return s.encode("latin-1").hex().upper()


# Brands of ISO media files; the first two that a file names beside its own count too, but for ``HEIF_OWN``.
HEIF_OWN = ["heic", "heif", "hevc"]
HEIF = ["mif1"]
MP4 = ["isom", "iso2", "mp41", "mp42", "MSNV"]
M4A = ["M4A ", "M4B "]
THREE_GP = ["3gp4", "3g2a"]


def _media(ext: str, mime: str, reason: str, brands: list[str], own: list[str] | None = None) -> Magic:
    """An ISO media file with one of the brands as its own (at byte 8) or among the first two it names, or one of ``own`` as its own."""
    places = [(8, b) for b in [*(own or []), *brands]] + [(at, b) for b in brands for at in (16, 20)]
    return Magic(ext, mime, reason, tuple(_at((4, _ascii("ftyp")), (at, _ascii(b))) for at, b in places))


# Formats in the order in which they are tried, before the plain prefixes.
MATCHERS = [
    Magic("tar", "application/x-tar", "tar:ustar", (_at((257, _ascii("ustar"))),)),
    Magic("wav", "audio/wav", "riff:wave", (_at((0, _ascii("RIFF")), (8, _ascii("WAVE"))),)),
    Magic("avi", "video/x-msvideo", "riff:avi", (_at((0, _ascii("RIFF")), (8, _ascii("AVI "))),)),
    Magic("webp", "image/webp", "riff:webp", (_at((0, _ascii("RIFF")), (8, _ascii("WEBP"))),)),
    Magic("evtx", "application/vnd.ms-windows.evtx", "evtx:ElfFile", (_at((0, _ascii("ElfFile\0"))),)),
    Magic("dmp", "application/x-ms-minidump", "dmp:MDMP", (_at((0, _ascii("MDMP"))),)),
    Magic("dmp", "application/x-ms-protected-dump", "dmp:protected", (_at((0, "F30E3EA171D5AF4E9FBBF80D0B19A3C06A1C5010E17AD44B8D2F12783C027482"), (32, "0200000040000000"), (48, "1B0200000002000020000000")),)),
    Magic("edb", "application/x-ese-database", "ese:header", (_at((0, "EFCDAB89")),)),
    Magic("hive", "application/x-windows-registry-hive", "regf", (_at((0, _ascii("regf"))),)),
    Magic("pol", "application/x-group-policy-registry-pol", "gpo:registry-pol", (_at((0, _ascii("PReg") + "01000000")),)),
    _media("heic", "image/heic", "ftyp:heif", HEIF, HEIF_OWN),
    _media("mp4", "video/mp4", "ftyp:mp4", MP4),
    _media("m4a", "audio/mp4", "ftyp:m4a", M4A),
    _media("3gp", "video/3gpp", "ftyp:3gp", THREE_GP),
    Magic("mp4", "video/mp4", "ftyp:mp4", (_at((4, _ascii("ftyp"))),)),
    Magic("sqlite", "application/vnd.sqlite3", "sqlite", (_at((0, _ascii("SQLite format 3\0"))),)),
    # a packet tag of the old or new format: also the first byte of a text that begins with a letter such as É
    Magic("gpg", "application/pgp-encrypted", "pgp:binary", tuple(_at((0, b)) for b in ("C1", "C3", "C9", "CB", "CC")), "Low"),
    Magic("kdbx", "application/x-keepass-kdbx", "kdbx:magic", (_at((0, "03D9A29A67FB4BB5")),)),
    Magic("7z", MIME["7z"], "7z", (_at((0, "377ABCAF271C")),)),
    Magic("rar", MIME["rar"], "rar5", (_at((0, "526172211A070100")),)),
    Magic("rar", MIME["rar"], "rar4", (_at((0, "526172211A0700")),)),
    Magic("elf", "application/x-elf", "elf", (_at((0, "7F454C46")),)),
    *(Magic("macho", "application/x-mach-binary", f"macho:{k}", (_at((0, v)),)) for k, v in {"be32": "FEEDFACE", "le32": "CEFAEDFE", "be64": "FEEDFACF", "le64": "CFFAEDFE", "fat": "CAFEBABE", "fat-le": "BEBAFECA"}.items()),
    Magic("cab", "application/vnd.ms-cab-compressed", "cab", (_at((0, _ascii("MSCF"))),)),
    Magic("glb", "model/gltf-binary", "glb", (_at((0, _ascii("glTF"))),)),
    Magic("tif", "image/tiff", "tiff", (_at((0, "49492A00")), _at((0, "4D4D002A")), _at((0, "4D4D002B")))),
]
# Prefixes in order; the confidence follows from their length.
PREFIXES = [
    ("png", "image/png", "89504E470D0A1A0A"), ("jpg", "image/jpeg", "FFD8FF"), ("gif", "image/gif", _ascii("GIF87a")), ("gif", "image/gif", _ascii("GIF89a")), ("pdf", "application/pdf", _ascii("%PDF-")),
    ("zip", "application/zip", "504B0304"), ("zip", "application/zip", "504B0506"), ("zip", "application/zip", "504B0708"), ("7z", "application/x-7z-compressed", "377ABCAF271C"), ("rar", "application/vnd.rar", "526172211A07"),
    ("gz", "application/gzip", "1F8B"), ("bmp", "image/bmp", "424D"), ("ogg", "application/ogg", _ascii("OggS")), ("mp3", "audio/mpeg", _ascii("ID3")), ("exe", "application/x-msdownload", "4D5A"),
    ("ole2", "application/vnd.ms-office", "D0CF11E0A1B11AE1"), ("bz2", "application/x-bzip2", _ascii("BZh")), ("xz", "application/x-xz", "FD377A585A00"), ("zst", "application/zstd", "28B52FFD"),
    ("wasm", "application/wasm", "0061736D"), ("pcapng", "application/x-pcapng", "0A0D0D0A"), ("pcap", "application/vnd.tcpdump.pcap", "D4C3B2A1"), ("pcap", "application/vnd.tcpdump.pcap", "A1B2C3D4"),
    ("parquet", "application/vnd.apache.parquet", _ascii("PAR1")), ("flac", "audio/flac", _ascii("fLaC")), ("crx", "application/x-chrome-extension", _ascii("Cr24")), ("ico", "image/x-icon", "00000100"),
    ("vob", "application/octet-stream", "000001BA"), ("cur", "application/octet-stream", "00000200"), ("heic", "image/heic", "0000206674797068656963"), ("hlp", "application/octet-stream", "0000FFFFFFFF"),
    ("accdb", "application/vnd.ms-access", "00010000" + _ascii("Standard ACE DB")), ("mdb", "application/vnd.ms-access", "00010000" + _ascii("Standard Jet DB")),
]
RULES = MATCHERS + [Magic(e, m if m != "application/octet-stream" else MIME.get(e, m), f"magic:{e}", (_at((0, h)),), "High" if len(h) >= 8 else "Medium" if len(h) == 6 else "Low") for e, m, h in PREFIXES]
#: Bytes of a header that the rules look at.
HEADER = 262


def magic_sql(header: str, field: str) -> str:
    """``ext``, ``mime``, ``reason`` or ``confidence`` of the first rule that holds, null if none does; ``header``: hex."""
    test = lambda o, h: f"substr({header}, {2 * o + 1}, {len(h)}) = '{h}'"
    holds = lambda m: " or ".join("(" + " and ".join(test(o, h) for o, h in t) + ")" for t in m.tests)
    return "case " + " ".join(f"when {holds(m)} then '{getattr(m, field)}'" for m in RULES) + " end"


def rule_sql(header: str) -> str:
    """The number of the first rule that holds."""
    test = lambda o, h: f"substr({header}, {2 * o + 1}, {len(h)}) = '{h}'"
    holds = lambda m: " or ".join("(" + " and ".join(test(o, h) for o, h in t) + ")" for t in m.tests)
    return "case " + " ".join(f"when {holds(m)} then {i}" for i, m in enumerate(RULES)) + " end"
