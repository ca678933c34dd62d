"""Queries of candidates: all types that a text could have, the primary one, and declared types against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textual
from ..functions.dialect import DUCK
from ..operators import candidates as cd
from ..operators import declared as dc
from ..operators import detect as dt
from .queries import _opened, _query, _steps, _table

# Extensions that the queries declare, by key.
_DECLARED = ["txt", "log", "ps1", "md", "js", "json", "csv", "yml", "ini", "toml", "conf", "cmd", "xml", "docx", "", "cer", "scr"]
_SAID = "case doc_id % 17 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(_DECLARED)) + " end"
_POINTS = {"ext:md": 7, "text:csv": -9, "reason:text:ps1": 2, "log": 3}
_SOURCE = f"select doc_id, {_opened('text', 'doc_id')} as text from documents"


def _emitted() -> str:
    """DuckDB: a row for each candidate of a document, scored."""
    cued = _steps(_SOURCE, [*textual.context_sql(DUCK, "text", _SAID), *cd.adjust_cues(DUCK)])
    rows = ", ".join(f"case when {holds} then {{'place': {i}, 'ext': '{r.ext}', 'reason': '{r.reason}', 'confidence': {confidence}, 'adjust': {adjust}}} end" for i, r, holds, confidence, adjust in cd.emitted_sql(DUCK))
    points = " + ".join(f"case when {'reason' if 'text:' in k else 'ext'} = '{k.removeprefix('ext:').removeprefix('reason:')}' then {v} else 0 end" for k, v in _POINTS.items())
    clamp = lambda raw: f"case confidence when 'High' then least(100, greatest(80, 90 + {raw})) when 'Medium' then least(79, greatest(60, 70 + {raw})) else least(59, greatest(40, 50 + {raw})) end"
    moved = f"(adjust + {points} + case when ext = decl then 3 else 0 end)"
    return f"""e as (select doc_id, decl, unnest([{rows}]) c from ({cued})),
s as (select doc_id, {clamp(moved)} score, ext, reason, confidence, place from (select doc_id, decl, c.* from e where c is not null)),
ranked as (select * from (select *, row_number() over (partition by doc_id, ext order by score desc, place) r from s) where r = 1)"""


@_query(
    f"""with {_emitted()}
select doc_id, coalesce(n, 0) n_candidates, coalesce(c, '') candidates from documents left join
  (select doc_id, count(*) n, string_agg(ext || ':' || confidence || ':' || score, ',' order by score desc, place) c from ranked group by doc_id) using (doc_id)"""
)
def text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type that a document behind an opening of another type could have, best first, under a table of settings."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_opened("text", "doc_id")).alias("text"))
    settings = spark.createDataFrame(list(_POINTS.items()), "key string, points long")
    found = cd.with_candidates(docs, "text", _SAID, settings)
    told = F.transform("candidates", lambda c: F.concat_ws(":", c["ext"], c["confidence"], c["score"].cast("string")))
    return found.select("doc_id", F.size("candidates").cast("long").alias("n_candidates"), F.array_join(told, ",").alias("candidates"))


# Pairs of extensions that stand for each other, as rows of SQL.
_STANDS = """stands as (select distinct d, f from (
  select unnest(['cer', 'crt', 'yml', 'yaml', 'admx', 'xml', 'ini', 'toml', 'inf', 'ini', 'inf', 'toml', 'bat', 'cmd', 'toml', 'inf']) d, unnest(['crt', 'cer', 'yaml', 'yml', 'xml', 'admx', 'toml', 'ini', 'ini', 'inf', 'toml', 'inf', 'cmd', 'bat', 'ini', 'inf']) f
  union all select d, f from (select unnest(['ps1', 'psm1', 'psd1']) d), (select unnest(['ps1', 'psm1', 'psd1', 'txt', 'log']) f)
  union all select d, f from (select unnest(['bat', 'cmd']) d), (select unnest(['txt', 'log']) f)
  union all select d, f from (select unnest(['txt', 'log', 'ini', 'md', 'csv', 'tsv']) d), (select unnest(['txt', 'log', 'ini', 'md', 'csv', 'tsv']) f)
  union all select 'conf', f from (select unnest(['xml', 'json', 'yml', 'ini', 'toml', 'txt']) f)
  union all select f, f from (select distinct ext f from ranked)))"""


def _chosen() -> str:
    """DuckDB: the primary type of each document, from the first rule and the candidates."""
    cued = _steps(_SOURCE, textual.context_sql(DUCK, "text", _SAID))
    first = f"select doc_id, decl, {textual.field_sql('_r', 'ext')} ext, {textual.field_sql('_r', 'reason')} reason from (select *, {textual.number_sql(DUCK)} _r from ({cued}))"
    generic = "(coalesce(p.ext, '') in ('', 'txt') or coalesce(p.reason, '') like '%text:plain%')"
    part = "(p.ext is null or p.ext in (" + ", ".join(repr(x) for x in cd.ELIGIBLE) + "))"
    return f"""p as ({first}), b as (select * from (select *, row_number() over (partition by doc_id order by score desc, place) q from ranked) where q = 1),
chosen as (select p.doc_id, p.decl, case when {part} and own.score is not null and b.ext <> p.ext and b.score >= own.score + 6 then b.ext
  when {part} and {generic} and said.score is not null and said.ext <> coalesce(p.ext, '') and b.score - said.score <= 2 then said.ext else p.ext end ext
  from p left join b using (doc_id) left join ranked own on own.doc_id = p.doc_id and own.ext = p.ext left join ranked said on said.doc_id = p.doc_id and said.ext = p.decl)"""


@_query(
    f"""with {_emitted()}, {_STANDS}, {_chosen()},
alt as (select r.doc_id, string_agg(r.ext, ',' order by r.score desc, place) strong, coalesce(bool_or(r.ext = c.decl), false) hit, string_agg(r.ext, ',' order by r.score desc, place) filter (r.ext in ('bat', 'cmd', 'ps1', 'psm1', 'psd1', 'vbs', 'js')) bad
  from ranked r join chosen c on c.doc_id = r.doc_id where (r.score >= 80 or r.confidence = 'High') and r.ext <> coalesce(c.ext, '') and c.ext is not null and c.decl <> '' group by r.doc_id),
m as (select c.*, c.decl = '' or c.ext is null missing, case when c.decl = '' or c.ext is null then false else s.d is null end off, coalesce(strong, '') strong, coalesce(hit, false) hit, coalesce(bad, '') bad
  from chosen c left join stands s on s.d = c.decl and s.f = c.ext left join alt on alt.doc_id = c.doc_id),
w as (select *, not (off and not hit) and decl in ('txt', 'log', 'conf', 'ini', 'md', 'csv') and bad <> '' bypass from m)
select doc_id, ext found, (off and not hit) or bypass mismatch, concat_ws(';', case when missing then 'no-detection-or-declared' when off then 'decl:' || decl || ' vs det:' || ext else 'match' end,
  case when off and hit then 'alt-match:declared' end, case when bypass then 'declared-bypass:strong-dangerous-alt' end, case when bad <> '' then 'alt-danger:' || bad end) reason, strong strong_alternatives, hit declared_matches_alternative from w"""
)
def declared_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary type of every document behind an opening of another type, compared with one declared by its key."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_opened("text", "doc_id")).alias("text"))
    settings = spark.createDataFrame(list(_POINTS.items()), "key string, points long")
    typed = dt.classify_text(docs, "text", _SAID).select("doc_id", "text", "extension", "reason")
    said = F.expr(_SAID)
    chosen = cd.with_candidates(typed, "text", _SAID, settings).withColumn("p", cd.choose_primary(F.col("extension"), F.col("reason"), F.col("candidates"), said))
    c = dc.compare_in_detail(said, F.col("p.ext"), F.col("candidates"))
    return chosen.select(
        "doc_id", F.col("p.ext").alias("found"), c["mismatch"].alias("mismatch"), c["reason"].alias("reason"), F.array_join(c["strong_alternatives"], ",").alias("strong_alternatives"), c["declared_matches_alternative"].alias("declared_matches_alternative"),
    )
