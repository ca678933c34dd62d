"""Content types of rows: leading bytes first, then cues of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import containers, magic, textual
from ..functions.dialect import SPARK
from ..functions.portable import portable_facts
from ..functions.types import is_dangerous, kind_sql, mime_of
from ..sources.blob import HEAD_BYTES

_FIELDS = ["extension", "mime_type", "confidence", "reason", "kind", "is_dangerous"]


def with_steps(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for step in steps:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df


def classify_text(df: DataFrame, text: str = "text", declared: str = "''") -> DataFrame:
    """``df`` with the type of a text column: ``extension, mime_type, confidence, reason, kind, is_dangerous``.

    Null and blank texts have no type.  ``declared``: SQL for a declared extension.
    """
    names = df.columns
    cued = with_steps(df.withColumn("_t", F.col(text)), textual.context_sql(SPARK, "_t", declared)).withColumn("_rule", F.expr(textual.number_sql(SPARK)))
    found = cued.select(*names, "_rule", *(F.expr(textual.field_sql("_rule", f)).alias(a) for f, a in (("ext", "extension"), ("mime", "mime_type"), ("reason", "reason"))), F.expr(textual.confidence_sql(SPARK, "_rule")).alias("confidence"))
    return _finish(found, names)


def _finish(found: DataFrame, names: list[str]) -> DataFrame:
    kind = F.when(F.col("extension").isNull(), "Unknown").otherwise(F.expr(kind_sql("extension", "mime_type")))
    return found.withColumns({"kind": kind, "is_dangerous": is_dangerous(F.col("extension"))}).select(*names, *_FIELDS)


def detect(blobs: DataFrame, declared: str = "coalesce(declared_ext, '')") -> DataFrame:
    """Rows of ``sources.blob`` or ``sources.ranged`` with their types.

    Leading bytes that no rule knows are text where they decode as UTF-8 or UTF-16.  Where they tell a ZIP or an OLE file,
    its entries tell which; executables are told apart by their headers; unknown ones may be disk images.  What isn't
    there as columns of ranges (``volume``, ``tail``, ``inside``) is taken from ``content``.  A generic text of low
    confidence takes a declared text extension; an empty or unknown content has no type.
    """
    names = blobs.columns
    ranged = "content" not in names
    header = blobs.withColumn("_hex", F.hex(F.substring("head", 1, magic.HEADER)))
    ruled = header.withColumn("_magic", F.expr(magic.rule_sql("_hex")))
    whole = F.col("head") if ranged else F.col("content")
    long = F.octet_length(whole) > containers.TAIL_BYTES
    volume = F.col("volume") if ranged else F.substring("content", containers.VOLUME_AT + 1, containers.VOLUME_BYTES)
    tail = F.col("tail") if ranged else F.when(long, F.substring("content", -containers.TAIL_BYTES, containers.TAIL_BYTES)).otherwise(F.col("content"))
    ruled = ruled.withColumn("_disk", F.when(F.col("_magic").isNull(), containers.disk_image(volume, tail)))
    holds = F.coalesce(F.col("_magic").isin([i for i, r in enumerate(magic.RULES) if r.ext in ("zip", "ole2")]), F.col("_hex").startswith("30"))
    ruled = ruled.withColumn("_inside", F.col("inside") if ranged else containers.inside(F.when(holds, F.col("content"))))
    ruled = ruled.withColumn("_t", F.when(F.col("_magic").isNull() & F.col("_disk").isNull(), containers.head_text(F.col("head"), HEAD_BYTES)))
    cued = with_steps(ruled, textual.context_sql(SPARK, "_t", declared)).withColumn("_rule", F.expr(textual.number_sql(SPARK)))
    of = lambda m: F.get(F.array(*(F.lit(getattr(r, m)) for r in magic.RULES)), F.col("_magic"))
    first = F.when(F.col("_magic").isNotNull(), F.struct(*(of(m).alias(m) for m in ("ext", "mime", "confidence", "reason"))))
    text = {"ext": F.expr(textual.field_sql("_rule", "ext")), "mime": F.expr(textual.field_sql("_rule", "mime")), "confidence": F.expr(textual.confidence_sql(SPARK, "_rule")), "reason": F.expr(textual.field_sql("_rule", "reason"))}
    base = cued.select(*names, "_t", "_inside", "decl", F.coalesce("_disk", containers.trace_log(F.col("head")), first, containers.der_type(F.col("_inside")), F.struct(*(v.alias(k) for k, v in text.items()))).alias("_base"))
    ext, found = F.col("_base.ext"), F.col("_inside")
    executable = containers.type_struct("", "", "High", F.col("_base.reason")).withField("ext", portable_facts(whole)["extension"]).withField("mime", F.col("_base.mime"))
    inner = (
        F.when(ext == "zip", containers.zip_type(found)).when(ext == "ole2", containers.ole_type(found)).when(ext == "json", containers.gltf_type(F.col("_t")))
        .when((ext == "exe") & portable_facts(whole).isNotNull(), executable)
    )
    one = base.select(*names, "decl", F.coalesce(inner, F.col("_base")).alias("_type"))
    generic = (F.col("_type.ext") == "txt") & F.col("decl").isin("log", "cfg", "conf", "ini", "inf", "md", "ps1", "cmd", "bat", "csv", "tsv", "yml", "yaml", "json", "xml")
    biased = F.when(generic, F.col("decl")).otherwise(F.col("_type.ext"))
    mime = F.when(generic, F.coalesce(mime_of(F.col("decl")), F.col("_type.mime"))).otherwise(F.col("_type.mime"))
    reason = F.when(generic, F.concat(F.col("_type.reason"), F.lit(";bias:decl:"), F.col("decl"))).otherwise(F.col("_type.reason"))
    return _finish(one.select(*names, biased.alias("extension"), mime.alias("mime_type"), F.col("_type.confidence").alias("confidence"), reason.alias("reason")), names)


def detect_magic(df: DataFrame, header_hex: str = "header_hex") -> DataFrame:
    """``df`` with ``extension, mime_type, reason, confidence`` by leading bytes alone, null where no rule holds."""
    ruled = df.withColumn("_magic", F.expr(magic.rule_sql(header_hex)))
    of = lambda field: F.get(F.array(*(F.lit(getattr(r, field)) for r in magic.RULES)), F.col("_magic"))
    return ruled.select(*df.columns, of("ext").alias("extension"), of("mime").alias("mime_type"), of("reason").alias("reason"), of("confidence").alias("confidence"))
