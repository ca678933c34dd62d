"""Declared types against what was found: which stand for which, and what strong alternatives say of a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.types import is_dangerous, let, normalise_extension

# Extensions that stand for each other; families in which each stands for each; declared ones that stand for those found.
PAIRS = [
    ("cer", "crt"), ("yml", "yaml"), ("jsonl", "ndjson"), ("jpg", "jpeg"), ("htm", "html"), ("admx", "xml"), ("adml", "xml"), ("ini", "toml"), ("inf", "ini"), ("inf", "toml"), ("bat", "cmd"), ("msi", "ole2"),
]
POWERSHELL = ["ps1", "psm1", "psd1"]
PLAIN = ["txt", "text", "log", "cfg", "conf", "ini", "md", "markdown", "properties", "prop", "csv", "tsv"]
CONFIG_NAMES = ["config", "conf", "cfg"]
CONFIG = ["xml", "json", "yml", "yaml", "ini", "conf", "cfg", "properties", "prop", "toml", "txt"]
#: Declared scripts may be found as text, not the other way: text found as a script is a dangerous renaming.
AS_TEXT = {"ps1": ["txt", "text", "log"], "psm1": ["txt", "text", "log"], "psd1": ["txt", "text", "log"], "bat": ["txt", "text", "log"], "cmd": ["txt", "text", "log"]}
AS_EXE = ["dll", "ocx", "cpl", "scr", "sys"]
STRONG_SCORE = 80


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def stands_for(declared: Column, found: Column) -> Column:
    """Whether a declared extension fits the one found; both in lower case and not null."""
    both = lambda names: declared.isin(names) & found.isin(names)
    config = F.when(declared.isin(CONFIG_NAMES), found.isin(CONFIG)).when(found.isin(CONFIG_NAMES), declared.isin(CONFIG))
    tests = [(declared == a) & (found == b) | (declared == b) & (found == a) for a, b in PAIRS]
    first = _any([declared == found, *tests])
    rest = _any([both(POWERSHELL), both(PLAIN), *((declared == k) & found.isin(v) for k, v in AS_TEXT.items()), declared.isin(AS_EXE) & (found == "exe")])
    return first | F.coalesce(config, rest)


def compare(declared: Column, found: Column, guessed: Column | None = None) -> Column:
    """``mismatch`` and ``reason``; no mismatch where either is missing.  ``guessed``: a second opinion that may agree."""
    names = F.struct(normalise_extension(declared).alias("d"), normalise_extension(found).alias("f"), (normalise_extension(guessed) if guessed is not None else F.lit(None).cast("string")).alias("g"))

    def told(n: Column) -> Column:
        d, f, g = n["d"], n["f"], n["g"]
        seen = F.when(f.isNotNull() & g.isNotNull() & ~stands_for(d, f) & stands_for(d, g), F.struct(g.alias("ext"), F.concat(g, F.lit(" (guess)")).alias("label")))
        seen = F.coalesce(seen, F.when(f.isNull(), F.struct(g.alias("ext"), F.concat(g, F.lit("(guess)")).alias("label"))), F.struct(f.alias("ext"), f.alias("label")))
        missing = d.isNull() | F.coalesce(f, g).isNull()
        return let(seen, lambda s: let(~missing & ~stands_for(d, s["ext"]), lambda wrong: F.struct(
            F.coalesce(wrong, F.lit(False)).alias("mismatch"),
            F.when(missing, "no-detection-or-declared").when(wrong, F.concat(F.lit("decl:"), d, F.lit(" vs det:"), s["label"])).otherwise("match").alias("reason"),
        )))

    return let(names, told)


def compare_in_detail(declared: Column, found: Column, candidates: Column, guessed: Column | None = None) -> Column:
    """``mismatch, reason, strong_alternatives, declared_matches_alternative, dangerous_alternatives, declared_dangerous,
    found_dangerous``: the plain comparison, seen again in the light of the candidates (of ``candidates.with_candidates``).

    A strong candidate of the declared type makes it a match; a strong dangerous one makes a plain declared text none.
    """
    asked = F.struct(
        compare(declared, found, guessed).alias("base"), normalise_extension(declared).alias("d"), normalise_extension(found).alias("f"),
        F.coalesce(normalise_extension(found), normalise_extension(guessed) if guessed is not None else F.lit(None).cast("string")).isNotNull().alias("seen"), candidates.alias("candidates"),
    )

    def told(a: Column) -> Column:
        d, f, base = a["d"], a["f"], a["base"]
        known = d.isNotNull() & a["seen"]
        strong = F.filter(a["candidates"], lambda c: ((c["score"] >= STRONG_SCORE) | (c["confidence"] == "High")) & ~F.coalesce(c["ext"] == f, F.lit(False)))
        names = F.when(known, F.transform(strong, lambda c: c["ext"])).otherwise(F.array().cast("array<string>"))
        return let(F.struct(names.alias("names"), F.slice(F.filter(names, lambda e: is_dangerous(e)), 1, 3).alias("dangerous"), (known & F.array_contains(names, d)).alias("matches")), lambda s: verdict(d, f, base, s))

    def verdict(d: Column, f: Column, base: Column, s: Column) -> Column:
        matches, risky = F.coalesce(s["matches"], F.lit(False)), F.size(s["dangerous"]) > 0
        bypass = ~(base["mismatch"] & ~matches) & ~is_dangerous(d) & F.coalesce(d.isin(PLAIN), F.lit(False)) & risky
        more = F.array_compact(F.array(F.when(base["mismatch"] & matches, "alt-match:declared"), F.when(bypass, "declared-bypass:strong-dangerous-alt"), F.when(risky, F.concat(F.lit("alt-danger:"), F.array_join(s["dangerous"], ",")))))
        return F.struct(
            ((base["mismatch"] & ~matches) | bypass).alias("mismatch"), F.array_join(F.concat(F.array(base["reason"]), more), ";").alias("reason"), s["names"].alias("strong_alternatives"), matches.alias("declared_matches_alternative"),
            s["dangerous"].alias("dangerous_alternatives"), is_dangerous(d).alias("declared_dangerous"), (is_dangerous(f) | risky).alias("found_dangerous"),
        )

    return let(asked, told)
