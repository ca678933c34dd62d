"""What names and simple measures of a content tell: odd names, markers of PDF files and services, lines, density."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import DANGEROUS, MIME, let

# Types of crash dumps, and of the programs that they may name; characters that turn the direction of writing.
DUMPS, DUMPED = ["dmp", "mdmp", "hdmp"], ["exe", "dll", "sys", "com", "scr", "cpl", "drv", "ocx"]
TURNS = "[\\u202A-\\u202E]"
# Flags of PDF files by what any of their markers says, in lower case.
PDF_MARKERS = {
    "pdf_javascript": ["/javascript", "/js"], "pdf_open_action": ["/openaction"], "pdf_aa": ["/aa"], "pdf_launch": ["/launch"], "pdf_names_tree": ["/names"], "pdf_xfa": ["/xfa"], "pdf_encrypted": ["/encrypt"],
}
PDF_CHARS, SERVICE_BYTES = 1 << 20, 256 * 1024


def name_issues(name: Column, mismatch: Column | None = None) -> Column:
    """``hidden, blanks, bidi, double_extension, mismatch`` of a file's name, those that hold, in this order; empty for null.

    A second extension counts unless all parts before the last are versions (letters, digits, ``_`` and ``-``, a digit among
    them, and no known extension), or the name is that of a program's crash dump, ``program.exe.1234.dmp``.
    """

    def told(n: Column) -> Column:
        base, ext = F.regexp_extract(n, r"(?s)^(.+)\.[^.]+$", 1), F.lower(F.regexp_extract(n, r"\.([^.]+)$", 1))
        parts = F.filter(F.split(base, r"\."), lambda p: p != "")
        known = lambda p: F.lower(p).isin([*DANGEROUS, *MIME])
        version = (F.size(parts) >= 2) & F.forall(F.slice(parts, 2, 1000), lambda p: F.trim(p).rlike(r"^[\p{L}\p{N}_-]*\p{Nd}[\p{L}\p{N}_-]*$") & ~known(F.trim(p)))
        bare = F.filter(F.split(F.regexp_replace(base, r"(?i)\.protected$", ""), r"\."), lambda p: p != "")
        dump = ext.isin(DUMPS) & (F.size(bare) >= 3) & F.coalesce(F.try_element_at(bare, F.lit(-1)).rlike(r"^\p{Nd}+$"), F.lit(False)) & F.coalesce(F.lower(F.try_element_at(bare, F.lit(-2))).isin(DUMPED), F.lit(False))
        double = base.rlike(r"(?s)^.+\.") & ~version & ~dump
        off = F.lit(False) if mismatch is None else F.coalesce(mismatch & (base != ""), F.lit(False))
        return F.array_compact(F.array(
            F.when((F.length(n) > 1) & n.startswith(".") & (n != ".."), "hidden"), F.when(n.rlike(r"(?s)^\s|\s$|  "), "blanks"), F.when(n.rlike(TURNS), "bidi"), F.when(double, "double_extension"), F.when(off, "mismatch"),
        ))

    return F.coalesce(let(F.coalesce(name, F.lit("")), told), F.array().cast("array<string>"))


def pdf_flags(content: Column) -> Column:
    """Flags of a PDF's first MiB: scripts, actions, embedded files (many: more than three), forms, encryption, updates."""

    def told(low: Column) -> Column:
        has = lambda m: low.contains(m)
        several = lambda pattern: F.regexp_count(low, F.lit(pattern))
        flags = [F.when(low.rlike("|".join(markers)), F.lit(flag)) for flag, markers in PDF_MARKERS.items()]
        embedded = has("/embeddedfiles") | (has("/filespec") & has("/ef"))
        return F.array_compact(F.array(*flags, F.when(embedded, "pdf_embedded_files"), F.when(several("/filespec") > 3, "pdf_many_embedded_files"), F.when(several("startxref") > 2, "pdf_many_updates")))

    return let(F.lower(F.decode(F.substring(content, 1, PDF_CHARS), "iso-8859-1")), told)


def line_estimate(content: Column, length: Column, sample: int = 1_000_000) -> Column:
    """Line feeds, counted in the first ``sample`` bytes and carried on to ``length``."""
    seen = F.octet_length(F.substring(content, 1, sample))
    counted = seen - F.octet_length(F.encode(F.translate(F.decode(F.substring(content, 1, sample), "iso-8859-1"), "\n", ""), "iso-8859-1"))
    return F.when(seen > 0, F.round(counted * F.greatest(F.lit(1.0), length / seen)).cast("int")).otherwise(F.when(content.isNotNull(), 0))


def is_minified(text: Column, least: int = 1024, line: int = 400, density: float = 0.85) -> Column:
    """Whether a script's lines are long, few and dense."""
    lines = F.regexp_count(text, F.lit("\n")) + 1
    dense = F.length(F.regexp_replace(text, r"\s", "")) / F.length(text)
    return F.coalesce((F.length(text) >= least) & (F.length(text) / lines > line) & (lines < F.floor(F.length(text) / 300)) & (dense > density), F.lit(False))


def has_service_marker(content: Column) -> Column:
    """Whether the first 256 KiB name a service's entry."""
    return F.coalesce(F.decode(F.substring(content, 1, SERVICE_BYTES), "iso-8859-1").contains("ServiceMain"), F.lit(False))
