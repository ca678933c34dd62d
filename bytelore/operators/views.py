"""Views of judged rows: long tables, report maps, labels and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, short and long label, severity of findings.
LEGEND = [
    ("ps:encoded", "Encoded command", "PowerShell runs an encoded command", 3), ("ps:iex", "Evaluates text", "PowerShell evaluates text as code", 3), ("ps:web-dl", "Web download", "Downloads from the web", 2),
    ("ps:reflection", "Reflection", "Loads code by reflection", 2), ("py:exec-b64", "Decoded exec", "Python runs decoded text", 3), ("py:exec", "Starts processes", "Python starts processes", 2), ("rb:eval", "Evaluates text", "Ruby evaluates text", 2),
    ("lua:exec", "Loads text", "Lua runs text as code", 2), ("bat:certutil", "Certutil decode", "Decodes a payload with certutil", 3), ("js:activex", "ActiveX", "Uses COM objects", 2), ("js:mshta", "Mshta", "Starts mshta", 3),
    ("js:fromcharcode", "Char codes", "Builds text of many character codes", 2), ("secret:privkey", "Private key", "Holds a private key", 3), ("secret:jwt", "Web token", "Holds a signed web token", 2), ("secret:keypattern", "Key assignment", "Assigns a key or password", 2),
    ("secret:token", "Vendor token", "Holds a vendor's token", 3), ("event-xml", "Event XML", "A Windows event in XML", 1), ("sysmon", "Sysmon", "A Sysmon event", 1), ("ldif", "LDIF", "A directory export", 1), ("log:iis-w3c", "IIS log", "A web server's log", 1),
]
LABELS = {"docx": "Word document", "xlsx": "Excel workbook", "pptx": "PowerPoint deck", "pdf": "PDF document", "zip": "ZIP archive", "exe": "Windows program", "dll": "Windows library", "ps1": "PowerShell script", "txt": "Plain text", "csv": "Comma-separated values", "json": "JSON", "xml": "XML", "html": "HTML page", "log": "Log file", "md": "Markdown"}


def legend(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEGEND, "code string, short string, long string, severity int")


def labelled(ext: Column) -> Column:
    """A readable name of a type, its upper-case extension if there is none."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in LABELS.items() for x in p)), ext), F.upper(ext))


def humanised(findings: Column, limit: int = 6) -> Column:
    """Short labels of findings, joined, the rest counted."""
    table = F.create_map(*(F.lit(x) for code, short, *_ in LEGEND for x in (code, short)))
    names = F.array_distinct(F.transform(findings, lambda f: F.coalesce(F.try_element_at(table, F.element_at(F.split(f, "="), 1)), f)))
    more = F.size(names) - limit
    return F.concat(F.array_join(F.slice(names, 1, limit), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def finding_rows(judged: DataFrame, id: str, findings: str) -> DataFrame:  # noqa: A002
    """A row for each finding, with its label and severity."""
    rows = judged.select(id, F.explode(findings).alias("code"))
    known = F.broadcast(legend(judged.sparkSession).withColumnRenamed("code", "base"))  # as many rows as LEGEND
    return rows.join(known, F.element_at(F.split("code", "="), 1) == F.col("base"), "left").drop("base")


def report_map(columns: dict[str, Column]) -> Column:
    """A map of those columns that are not null, as strings."""
    pairs = F.create_map(*(x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def markdown(title: Column, sections: dict[str, Column]) -> Column:
    """A title and a line for each section that is neither null nor empty."""
    lines = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"- **{k}**: "), c.cast("string"))) for k, c in sections.items()]
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), *lines)


def candidates_display(candidates: Column, primary: Column) -> Column:
    """The first five candidates as ``*.ps1 High 90; .txt Low 50``, the primary one marked; null where there are none."""
    told = F.transform(F.filter(candidates, lambda c: c["ext"] != ""), lambda c: F.concat(F.when(c["ext"] == primary, "*.").otherwise("."), F.concat_ws(" ", c["ext"], c["confidence"], c["score"].cast("string"))))
    return F.nullif(F.array_join(F.slice(told, 1, 5), "; "), F.lit(""))


def _csv(names: str) -> Column:
    return F.array_join(names, ",")


def view(record: DataFrame, which: str) -> DataFrame:
    """One of the flat views of records of ``analyze``: summary, detection, analysis, assessment, certificate, executable."""
    fields = {
        "summary": {"kind": F.col("detection.kind"), "extension": F.col("detection.extension"), "mime_type": F.col("detection.mime_type"), "confidence": F.col("detection.confidence"), "reason": F.col("detection.reason"), "flags": _csv("flags")},
        "detection": {
            "extension": F.col("detection.extension"), "mime_type": F.col("detection.mime_type"), "confidence": F.col("detection.confidence"), "reason": F.col("detection.reason"), "score": F.col("detection.score"), "is_dangerous": F.col("detection.is_dangerous"),
            "alternatives": candidates_display(F.col("alternatives"), F.lit("")), "sha256": F.col("sha256"), "header_hex": F.col("header_hex"),
        },
        "analysis": {
            "extension": F.col("detection.extension"), "kind": F.col("detection.kind"), "flags": _csv("flags"), "container_subtype": F.col("container.subtype"), "container_entry_count": F.col("container.entry_count"), "container_top_extensions": _csv("container.top_extensions"),
            "estimated_line_count": F.col("line_count"), "findings": _csv("findings"), "pe_machine": F.col("executable.machine"), "pe_subsystem": F.col("executable.subsystem"),
        },
        "assessment": {"score": F.col("assessment.score"), "decision": F.col("assessment.decision"), "decision_strict": F.col("assessment.decision_strict"), "decision_lenient": F.col("assessment.decision_lenient"), "codes": _csv("assessment.codes")},
        "certificate": {"subject": F.col("certificate.subject"), "issuer": F.col("certificate.issuer"), "bundle_count": F.when(F.col("certificate.bundle").isNotNull(), F.size("certificate.bundle"))},
        "executable": {"machine": F.col("executable.machine"), "subsystem": F.col("executable.subsystem"), "sections": _csv("executable.sections"), "n_exports": F.col("executable.n_exports"), "company": F.col("executable.version")["CompanyName"], "version": F.col("executable.version")["FileVersion"]},
    }
    if which not in fields:
        raise ValueError(f"views are {', '.join(fields)}")
    return record.select("id", "name", *(c.alias(k) for k, c in fields[which].items()))
