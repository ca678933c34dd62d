"""All that is known of a content, as one wide record: its type and its rivals, what it holds, what it refers to, its risk.

Bytes are walked once: one Arrow step reads the directories and headers of each row, whatever it is, and tells of an error
in a row instead of failing.  All else is expressions over what that step and the leading bytes gave.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compound, containers, der, findings, image, magic, metrics, payloads, references, scripts, zipdir
from ..functions.portable import portable_facts
from ..functions.types import is_dangerous, mime_of
from ..sources.blob import HEAD_BYTES
from . import archives, assess, candidates, declared, office
from .detect import detect

#: Characters of a text that findings look at.
TEXT_CHARS = 256 * 1024
_FACTS = pa.struct(
    [
        ("entries", pa.list_(archives._ENTRY)), ("safety", archives._SAFETY), ("parts", office._PARTS), ("ole", pa.list_(pa.string())), ("sections", pa.list_(pa.string())), ("exports", pa.list_(pa.string())),
        ("version", pa.map_(pa.string(), pa.string())), ("subject", pa.string()), ("issuer", pa.string()), ("bundle", pa.list_(pa.string())), ("error", pa.string()),
    ]
)
_FACTS_SQL = (
    f"struct<entries:{archives._ENTRY_SQL},safety:{archives._SAFETY_SQL},parts:{office._PARTS_SQL},ole:array<string>,sections:array<string>,exports:array<string>,"
    "version:map<string,string>,subject:string,issuer:string,bundle:array<string>,error:string>"
)


def _facts(content: bytes | None) -> dict:
    """What directories and headers tell; ``error`` where reading them failed."""
    out: dict = dict.fromkeys(f.name for f in _FACTS)
    if not content:
        return out
    read = zipdir.reader(content)
    try:
        if content[:2] == b"PK":
            out["entries"] = archives.zip_entries(content)
            found = zipdir.entries(read, len(content)) or []
            chosen = ((e.name, zipdir.body(read, e, office.PART_BYTES)) for e in found if office.PARTS.fullmatch(e.name))
            out["parts"] = [{"name": n, "body": b.decode("utf-8", "replace")} for n, b in chosen if b is not None]
        elif content[257:262] == b"ustar":
            out["entries"], out["safety"] = archives.tar_entries(content), archives.tar_safety(content)
        elif content[:8] == compound.MAGIC:
            out["ole"] = [e.name for e in compound.entries(read, len(content)) or []]
        elif content[:2] == b"MZ":
            seen = image.parse(read, len(content))
            if seen:
                out |= {"sections": [s[0] for s in seen.sections], "exports": seen.exports, "version": list(seen.version.items())}
        elif content[:1] == b"0":
            known = der.facts(content) or {}
            out |= {k: known.get(k) for k in ("subject", "issuer", "bundle")}
        else:
            out["entries"] = archives.packed_entries(content)
    except Exception as e:  # one row's fault is that row's alone
        out = dict.fromkeys(out) | {"error": f"{type(e).__name__}: {e}"}
    return out


def _with_facts(rows: DataFrame) -> DataFrame:
    at = rows.columns.index("content")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([_facts(x.as_py()) for x in b.column(at)], _FACTS)
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*names, "_facts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, _facts {_FACTS_SQL}")


def _settled(df: DataFrame) -> DataFrame:
    """``df`` as a step of its own: filters on what it works out are not put in the place of what they name, over and over.

    An observed count is such a step, without leaving the engine or writing anything.
    """
    return df.observe(f"analyze-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def _none() -> Column:
    return F.array().cast("array<string>")


def analyze(blobs: DataFrame, allowed_domains: list[str] = (), allowed_vendors: list[str] = (), settings: dict[str, int] | None = None) -> DataFrame:
    """One record for each row of ``sources.blob``:

    ``id, name, declared_ext, length, sha256, header_hex, detection`` (type, confidence, reason, kind, danger, score),
    ``alternatives, declared`` (mismatch and reason), ``flags, findings, secrets`` (counts by kind), ``container`` (entries,
    encrypted ones, commonest extensions, subtype), ``office, certificate, executable, encoded, links, name_issues,
    line_count, is_minified, has_service, assessment, error``.

    Null and empty contents have no type, no findings and a score of 0.  A row whose structures can't be read has the reason
    in ``error`` and all else that is known.  An empty table gives no rows; rows that repeat an id are analysed each.
    """
    base = detect(blobs).select("id", "name", "declared_ext", "length", "content", "head", F.col("extension").alias("_ext"), F.col("mime_type").alias("_mime"), F.col("confidence").alias("_conf"), F.col("reason").alias("_reason"), F.col("kind").alias("_kind"))
    textual = F.col("_kind").isin("Text") | F.coalesce(F.col("_reason").startswith("text:"), F.lit(False))
    whole = F.try_validate_utf8(F.substring("content", 1, TEXT_CHARS).cast("string"))
    texts = base.withColumn("_text", F.when(textual, F.coalesce(whole, containers.head_text(F.col("head"), HEAD_BYTES))))
    said = "coalesce(declared_ext, '')"
    ranked = candidates.with_candidates(_with_facts(texts), "_text", said, settings)
    chosen = ranked.withColumn("_p", candidates.choose_primary(F.col("_ext"), F.col("_reason"), F.col("candidates"), F.col("declared_ext")))
    ext, low = F.col("_p.ext"), F.lower("_text")
    text = F.coalesce("_text", F.lit(""))

    # what it holds
    facts = F.col("_facts")
    listed = F.when(facts["entries"].isNotNull(), archives.archive_facts(facts["entries"], "_facts.safety"))
    linked = F.when(facts["parts"].isNotNull(), office.link_facts(F.transform(facts["entries"], lambda e: e["name"]), facts["parts"], list(allowed_domains)))
    kind = F.when(ext.isin([*payloads.ENCODED]), ext)
    inner = payloads.payload(F.col("_text"), kind)
    number = F.expr(magic.rule_sql("_inner_hex"))
    held = _settled(chosen).select("*", listed.alias("_archive"), linked.alias("_office"), kind.alias("_encoded"), F.hex(F.substring(inner, 1, magic.HEADER)).alias("_inner_hex")).withColumn("_inner", F.get(F.array(*(F.lit(r.ext) for r in magic.RULES)), number))
    program = portable_facts(F.col("content"))
    packed = F.exists(facts["sections"], lambda s: F.upper(s).startswith("UPX"))
    macros = ext.isin("doc", "xls", "ppt") & F.coalesce(containers.has_macros(F.struct(facts["ole"].alias("names"))), F.lit(False))
    flags = F.array_distinct(F.concat(
        F.coalesce("_archive.flags", _none()), F.coalesce("_office.flags", _none()), F.coalesce(program["flags"], _none()), F.when(ext == "pdf", metrics.pdf_flags(F.col("content"))).otherwise(_none()),
        F.array_compact(F.array(F.when(macros, "ole_macros"), F.when(packed, "pe_packed"), F.when(F.col("_encoded").isNotNull(), F.concat(F.lit("encoded_"), "_encoded")))),
    ))

    # what it says and refers to
    is_script = ext.isin([*candidates.SCRIPTS])
    uris = F.when(is_script, scripts.script_data_uris(F.col("_text"))).when(ext == "html", scripts.html_data_uris(F.col("_text")))
    held = held.withColumn("_uris", uris)  # worked out outside the engine, so a column before any lambda
    data_found = F.when(is_script, scripts.data_findings(F.col("_uris"), "script")).when(ext == "html", scripts.data_findings(F.col("_uris"), "html"))
    counts = {"private_keys": findings.private_keys(text), "key_patterns": findings.key_patterns(text), "web_tokens": references.web_tokens(text), **{k.replace("-", "_"): findings.tokens(text, k) for k in findings.TOKENS}, "azure_sas": findings.azure_sas(text)}
    codes = {"private_keys": "secret:privkey", "key_patterns": "secret:keypattern", "web_tokens": "secret:jwt", "azure_sas": "secret:token:azure-sas", **{k.replace("-", "_"): f"secret:token:{k}" for k in findings.TOKENS}}
    stepped = held.select(
        "*", flags.alias("_flags"), program.alias("_program"), F.coalesce(data_found, _none()).alias("_data"), F.struct(*(c.cast("int").alias(k) for k, c in counts.items())).alias("_secrets"),
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s\"'<>)\]]+"), F.lit(0)), F.lower)).alias("_links"),
    )
    secret_codes = F.array_compact(F.array(*(F.when(F.col(f"_secrets.{k}") > 0, F.lit(code)) for k, code in codes.items())))
    exported = F.array_compact(F.array(
        F.when(F.size(facts["exports"]) > 0, F.concat(F.lit("pe:exports="), F.size(facts["exports"]).cast("string"))),
        F.when(F.exists(facts["exports"], lambda e: F.lower(e).isin("dllregisterserver", "dllinstall", "dllunregisterserver")), "pe:regsvr"),
    ))
    encoded_found = F.when(F.col("_encoded").isNotNull(), F.array(F.concat(F.lit("enc:"), "_encoded"), F.concat(F.lit("enc:det:"), F.coalesce("_inner", F.lit("")))))
    told = F.array_distinct(F.concat(
        F.when(F.col("_text").isNotNull(), findings.script_findings(F.col("_text"))).otherwise(_none()), F.coalesce(findings.network_findings(F.col("_text"), list(allowed_domains)), _none()), F.coalesce("_office.findings", _none()),
        F.col("_data"), F.coalesce(encoded_found, _none()), F.when(macros, F.array(F.lit("office:vba"))).otherwise(_none()), F.coalesce(exported, _none()), secret_codes,
    ))
    compared = declared.compare_in_detail(F.col("declared_ext"), ext, F.col("candidates"), F.col("_archive.subtype"))
    issues = metrics.name_issues(F.col("name"), F.col("_compared.mismatch"))
    known = _settled(stepped).select("*", told.alias("_found"), compared.alias("_compared")).withColumn("_issues", issues)

    first = F.get(F.filter("candidates", lambda c: c["ext"] == ext), 0)
    rivals = F.slice(F.filter("candidates", lambda c: ~F.coalesce(c["ext"] == ext, F.lit(False))), 1, 5)
    guess, subtype = F.col("_archive.subtype"), F.coalesce("_archive.subtype", ext)
    confidence = F.coalesce("_p.confidence", "_conf")
    by_code = {"private_keys": "Secret.PrivateKey", "web_tokens": "Secret.JWT", "key_patterns": "Secret.KeyPattern", **{k.replace("-", "_"): assess.FINDINGS[f"secret:token:{k}"][0] for k in findings.TOKENS}, "azure_sas": "Secret.TokenFamily.AzureSas"}
    known = known.withColumn("_by_finding", assess.finding_factors(F.col("_found"), F.col("_flags")))
    found_factors = F.col("_by_finding")
    early = [f for f in assess.FLAGS if f not in assess.LATER_FLAGS]
    factors = F.concat(
        assess.flag_factors(F.col("_flags"), subtype, early), assess.encoded_factors(F.col("_encoded"), F.col("_inner"), F.col("_found")), assess.flag_factors(F.col("_flags"), subtype, assess.LATER_FLAGS),
        assess.signature_factors(ext, subtype), found_factors, assess.volume_factors({code: F.col(f"_secrets.{k}") for k, code in by_code.items()}, F.transform(found_factors, lambda f: f["code"])),
        assess.name_factors(F.col("_issues")), assess.type_factors(ext, confidence, F.col("_p.reason"), F.col("candidates"), F.col("_compared.mismatch"), guess),
        assess.package_factors(F.col("_facts.version")["CompanyName"], ext.isin("msi", "msix", "appx"), F.lit(None).cast("string"), F.col("_found"), allowed=list(allowed_vendors)),
    )
    changed = ~F.coalesce(ext == F.col("_ext"), F.lit(False))
    judged = _settled(known.withColumn("_factors", factors))  # a column, as the fold reads it many times
    record = judged.select(
        "id", "name", "declared_ext", "length", F.sha2("content", 256).alias("sha256"), F.hex(F.substring("content", 1, 16)).alias("header_hex"),
        F.struct(ext.alias("extension"), F.when(changed, mime_of(ext, F.lit(None).cast("string"))).otherwise(F.col("_mime")).alias("mime_type"), confidence.alias("confidence"), F.col("_p.reason").alias("reason"), F.col("_kind").alias("kind"), is_dangerous(ext).alias("is_dangerous"), first["score"].alias("score")).alias("detection"),
        rivals.alias("alternatives"), F.struct("_compared.mismatch", "_compared.reason", "_compared.dangerous_alternatives").alias("declared"), F.col("_flags").alias("flags"), F.col("_found").alias("findings"), F.col("_secrets").alias("secrets"),
        F.struct("_archive.entry_count", "_archive.encrypted_count", "_archive.top_extensions", "_archive.subtype").alias("container"), F.struct("_office.external_links", "_office.hosts").alias("office"),
        F.struct("_facts.subject", "_facts.issuer", "_facts.bundle").alias("certificate"), F.struct("_program.machine", "_program.subsystem", "_facts.sections", "_facts.version", F.size("_facts.exports").alias("n_exports")).alias("executable"),
        F.struct(F.col("_encoded").alias("kind"), F.col("_inner").alias("inner_extension")).alias("encoded"), F.col("_links").alias("links"), F.col("_issues").alias("name_issues"),
        F.when(F.col("_text").isNotNull(), metrics.line_estimate(F.col("content"), F.col("length"))).alias("line_count"), (ext.isin("js") & metrics.is_minified(F.col("_text"))).alias("is_minified"), metrics.has_service_marker(F.col("content")).alias("has_service"), assess.assess(F.col("_factors")).alias("assessment"), F.col("_facts.error").alias("error"),
    )
    return _settled(record)


def first_key_wins(*maps: Column) -> Column:
    """One map of several, in which a key keeps the value of the first map that has it; null maps count as empty."""
    entries = F.concat(*(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps))
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def summary_map(extra: Column | None = None) -> Column:
    """The flat report of a record of ``analyze``: text by name, what is null or empty left out; ``extra`` gives way to it."""
    flat = {
        "extension": F.col("detection.extension"), "mimeType": F.col("detection.mime_type"), "confidence": F.col("detection.confidence"), "kind": F.col("detection.kind"), "sha256": F.col("sha256"), "length": F.col("length").cast("string"),
        "flags": F.array_join("flags", ","), "findings": F.array_join("findings", ","), "score": F.col("assessment.score").cast("string"), "decision": F.col("assessment.decision"), "entryCount": F.col("container.entry_count").cast("string"),
        "certificateSubject": F.col("certificate.subject"), "companyName": F.col("executable.version")["CompanyName"], "declaredReason": F.col("declared.reason"), "error": F.col("error"),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in flat.items()))
    own = F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"] != "", F.lit(False))))
    return own if extra is None else first_key_wins(own, extra)
