"""All types that a text could have: every rule that holds gives a candidate, scored, adjusted and ranked.

``detect.classify_text`` takes the first rule that holds; here each rule is asked.  Cues of other families lower a score, a
table of settings moves it, and the best candidate may take the primary's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textual
from ..functions.dialect import SPARK, Dialect
from ..functions.types import is_dangerous
from . import rank
from .detect import with_steps

# Types that take part, those that are scripts, and how cues of other families and a type's own change scores.
ELIGIBLE = ["txt", "text", "log", "md", "markdown", "ps1", "psm1", "psd1", "vbs", "js", "sh", "bat", "cmd", "py", "rb", "lua", "xml", "admx", "adml", "html", "json", "ndjson", "csv", "tsv", "ini", "inf", "toml", "yml", "yaml"]
SCRIPTS = ["ps1", "psm1", "psd1", "vbs", "js", "sh", "bat", "cmd", "py", "rb", "lua"]
PENALTIES = {
    "script_from_log": -8, "script_from_md_declared": -10, "script_from_md_structure": -8, "script_from_md": -6, "log_from_script": -8, "log_from_md": -4, "json_from_script": -4, "json_from_log": -4,
    "yml_from_log": -6, "yml_from_script": -4, "md_from_ini": -6, "txt_from_script": -8, "txt_from_log": -6, "txt_from_md": -4,
}
BONUSES = {"ndjson_two": 8, "ndjson_three": 10, "ini": 4, "md_structure": 4, "vbs_block": 4, "ps_shebang": 6, "ps_verb_noun": 4, "ps_pipeline": 2, "ps_module": 2, "ps_get_set": 1, "ps_strict": 1, "ps_version": 1}
#: Most entries of a table of settings, which becomes part of the query.
MOST_SETTINGS = 10_000
CANDIDATE = "struct<ext string, mime string, confidence string, reason string, adjust int>"


def adjust_cues(d: Dialect) -> list[dict[str, str]]:
    """Columns that ``adjust_sql`` reads, after those of ``textual.context_sql``."""
    has, n = d.has, d.number
    heading = f"(left(hl, 2) = '# ' or {has('hl', chr(10) + '# ')})"
    bullets = has("hl", "\n- ", "\n* ", "\n1. ")
    marks = f"(2 * cast({has('hl', '```')} as int) + {n(heading, has('hl', ']('), bullets)})"
    later = d.like("h", "^[^\\n]*\\n[ \\t\\r\\n]*[^ \\t\\r\\n]")
    return [
        {"md_fence": has("hl", "```"), "md_heading": heading, "md_marks": f"({marks} + case when {marks} = 1 and {later} then 1 else 0 end)", "declared_md": "(decl in ('md', 'markdown'))"},
        {"md_likely": "(md_fence or md_marks >= 2 or (declared_md and md_marks >= 1))", "yml_strong": "(yaml_keys >= 2 or (yaml_keys >= 1 and yaml_items >= 1) or yaml_items >= 3)"},
    ]


def adjust_sql(d: Dialect, rule: textual.TextRule, holds_ini: str) -> str:
    """How the cues move the score of a rule's candidate."""
    p, b, has = PENALTIES, BONUSES, d.has
    when = lambda test, points: f"case when {test} then {points} else 0 end"
    from_md = f"case when not md_likely then 0 when declared_md then {p['script_from_md_declared']} when md_fence then {p['script_from_md_structure']} else {p['script_from_md']} end"
    parts: list[str] = []
    if rule.ext in SCRIPTS:
        parts += [when("log_cues", p["script_from_log"]), from_md]
    if rule.ext in ("ps1", "psm1", "psd1"):
        shebang = has("hl", "#!/usr/bin/env pwsh", "#!/usr/bin/pwsh", "#!/usr/bin/env powershell", "#!/usr/bin/powershell")
        pipeline = f"({has('hl', '| where-object', '| foreach-object', '| select-object')} and {has('h', '$')})"
        parts += [
            when(shebang, b["ps_shebang"]), when("verb_noun", b["ps_verb_noun"]), when(pipeline, b["ps_pipeline"]), when(has("hl", "export-modulemember", "functionstoexport", "rootmodule"), b["ps_module"]),
            when(has("hl", "get-", "set-"), b["ps_get_set"]), when(has("hl", "set-strictmode"), b["ps_strict"]), when(has("hl", "$psversiontable"), b["ps_version"]),
        ]
    own = {
        "log": [when("script", p["log_from_script"]), when("md_likely", p["log_from_md"])], "json": [when("script", p["json_from_script"]), when("log_cues", p["json_from_log"])],
        "yml": [when("log_cues", p["yml_from_log"]), when("script and not yml_strong", p["yml_from_script"])], "ini": [str(b["ini"])], "ndjson": [f"case when {rule.confidence} = 'Medium' then {b['ndjson_three']} else {b['ndjson_two']} end"],
        "md": [when("md_fence or md_heading", b["md_structure"]), when(f"{holds_ini} and not declared_md", p["md_from_ini"])], "vbs": [when(has("hl", "end sub", "end function"), b["vbs_block"])],
        "txt": [when("script", p["txt_from_script"]), when("log_cues", p["txt_from_log"]), when("md_likely", p["txt_from_md"])],
    }.get(rule.ext, [])
    return " + ".join(parts + own) or "0"


def confidence_of(rule: textual.TextRule) -> str:
    """A candidate's confidence, as SQL; scripts and Markdown are surer here than as the first rule that holds."""
    if rule.reason == "text:ps1":
        return "case when ps_strong + ps_weak >= 3 or ps_strong >= 2 then 'High' else 'Medium' end"
    if rule.reason == "text:ps1-shebang":
        return "'High'"
    return "case when md_fence or md_heading then 'Medium' else 'Low' end" if rule.ext == "md" else rule.confidence


def emitted_sql(d: Dialect) -> list[tuple[int, textual.TextRule, str, str, str]]:
    """Number, rule, whether it holds, confidence and adjustment of every rule that can give a candidate."""
    all_rules = textual.rules(d)
    ini = next(r.when for r in all_rules if r.ext == "ini")
    return [(i, r, r.when, confidence_of(r), adjust_sql(d, r, f"({ini})")) for i, r in enumerate(all_rules) if r.ext in ELIGIBLE]


def settings_of(table: DataFrame) -> dict[str, int]:
    """A table of ``key`` and ``points``, at most ``MOST_SETTINGS`` rows, summed by key; more is an error."""
    rows = table.groupBy("key").agg({"points": "sum"}).limit(MOST_SETTINGS + 1).collect()
    if len(rows) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    return {r[0]: int(r[1]) for r in rows if r[0] is not None and r[1] is not None}


def _moved(settings: dict[str, int], ext: Column, reason: Column) -> Column:
    """The points that settings add: those named by the extension or the reason, plain or after ``ext:`` or ``reason:``."""
    if not settings:
        return F.lit(0)
    table = F.create_map(*(F.lit(x) for pair in settings.items() for x in pair))
    return sum((F.coalesce(F.try_element_at(table, k), F.lit(0)) for k in (ext, F.concat(F.lit("ext:"), ext), reason, F.concat(F.lit("reason:"), reason))), F.lit(0))


def with_candidates(df: DataFrame, text: str = "text", declared: str = "''", settings: dict[str, int] | DataFrame | None = None) -> DataFrame:
    """``df`` with ``candidates``: one of each type, best first, ties in the order of the rules (``ext, mime, confidence,
    reason, score, is_dangerous``); an empty array where no rule holds, as for null and blank texts.

    ``declared``: SQL for a declared extension, whose candidate gains points.  ``settings``: points by key, as a dictionary
    or a small table (see ``settings_of``).
    """
    points = settings_of(settings) if isinstance(settings, DataFrame) else (settings or {})
    names = df.columns
    cued = with_steps(df.withColumn("_t", F.col(text)), [*textual.context_sql(SPARK, "_t", declared), *adjust_cues(SPARK)])
    made = F.array_compact(F.array(*(
        F.when(F.expr(holds), F.struct(F.lit(r.ext).alias("ext"), F.lit(r.mime).alias("mime"), F.expr(confidence).alias("confidence"), F.lit(r.reason).alias("reason"), F.expr(adjust).cast("int").alias("adjust")))
        for _, r, holds, confidence, adjust in emitted_sql(SPARK)
    )))
    emitted = cued.select(*names, "decl", made.alias("_made"))
    pick = lambda table, c: F.coalesce(*(F.when(c["confidence"] == k, F.lit(v)) for k, v in table.items()))

    def one(c: Column, i: Column) -> Column:
        raw = pick(rank.BASE, c) + c["adjust"] + _moved(points, c["ext"], c["reason"]) + F.when(c["ext"] == F.col("decl"), rank.DECLARED_BOOST).otherwise(0)
        low, high = (pick({k: v[j] for k, v in rank.RANGE.items()}, c) for j in (0, 1))
        fields = [c[f].alias(f) for f in ("ext", "mime", "confidence", "reason")]
        return F.struct((-F.least(high, F.greatest(low, raw))).alias("less"), i.alias("place"), *fields)

    scored = emitted.withColumn("_scored", F.array_sort(F.transform("_made", one)))
    best = F.filter("_scored", lambda c, i: F.array_position(F.transform("_scored", lambda x: x["ext"]), c["ext"]) == i + 1)
    out = F.transform(best, lambda c: F.struct(*(c[f].alias(f) for f in ("ext", "mime", "confidence", "reason")), (-c["less"]).alias("score"), is_dangerous(c["ext"]).alias("is_dangerous")))
    return scored.select(*names, F.coalesce(out, F.array().cast("array<struct<ext:string,mime:string,confidence:string,reason:string,score:int,is_dangerous:boolean>>")).alias("candidates"))


def choose_primary(extension: Column, reason: Column, candidates: Column, declared: Column) -> Column:
    """``ext, confidence, reason, score``: the type found by the first rule, unless a candidate leads its own by the margin;
    a generic one yields to the declared type where that comes close to the best.  Types that take no part stay."""
    named = lambda ext: F.get(F.filter(candidates, lambda c: c["ext"] == ext), 0)
    pick = lambda c, tag: F.struct(c["ext"].alias("ext"), c["confidence"].alias("confidence"), F.concat(c["reason"], F.lit(tag)).alias("reason"), c["score"].alias("score"))
    own, best, said = named(extension), F.get(candidates, 0), named(declared)
    leads = own.isNotNull() & (best["ext"] != extension) & (best["score"] >= own["score"] + rank.PRIMARY_MARGIN)
    generic = F.coalesce(extension, F.lit("")).isin("", "txt", "text") | F.coalesce(reason, F.lit("")).contains("text:plain")
    near = generic & said.isNotNull() & (said["ext"] != F.coalesce(extension, F.lit(""))) & (best["score"] - said["score"] <= rank.TIE_MARGIN)
    kept = F.struct(extension.alias("ext"), own["confidence"].alias("confidence"), reason.alias("reason"), own["score"].alias("score"))
    takes_part = extension.isNull() | extension.isin(ELIGIBLE)
    return F.when(takes_part & leads, pick(best, ";primary:score")).when(takes_part & near, pick(said, ";primary:declared")).otherwise(kept)
