"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, toxicity, warc, whiten
from ._scratch import new_folder
from .decontam import find_contamination
from .linedup import later_matches
from .maxent import score_texts
from .neardup import near_duplicates
from .packing import pack_sequences
from .pii import pseudonymise
from .quality import repetition_quality
from .secrets import find_secrets
from .variants import spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-array repetition counts and verdict of every document."""
    return repetition_quality(_table(spark, sf_dir, "documents"))


@_query
def op2_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = _table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.train(docs.where(part != 1))
    return langid.predict(docs, model).select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score", "n_grams")


@_query
def op3_chosen_path_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, by sets of four-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLE_SQL["op3_chosen_path_duplicates"] = f"""
with recursive d as (select doc_id, coalesce({_WORDS}, []) w from documents),
pieces as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) s from d),
sets as (select distinct doc_id, s from pieces),
n as (select doc_id, count(*) n from sets group by doc_id),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
reach as (select doc_id, doc_id r from d union select reach.doc_id, links.y from reach join links on links.x = reach.r)
select doc_id, coalesce(n.n, 0) n_shingles, min(r) component_id, doc_id = min(r) kept
from reach left join n using (doc_id) group by doc_id, n.n"""


@_query
def op4_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates under a fixed key."""
    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), b"the key of the test query")


@_query
def op5_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labelled ones."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("toxic_passages").cast("long").alias("n_passages"))


@_query
def op6_line_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that an earlier line matches."""
    docs = _table(spark, sf_dir, "documents")
    gone = later_matches(docs).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    n_lines = F.greatest(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_lines.alias("n_lines"))
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    return lines.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines"))


ORACLE_SQL["op6_line_set_join"] = """
with l as (select doc_id, line_no - 1 line_no, lines[line_no] line from
  (select doc_id, string_split(text, chr(10)) lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) line_no from documents)),
k as (select doc_id, line_no, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+'))) w from l),
big as (select *, len(w) n from k where len(w) >= 1),
sets as (select w, n, min((doc_id, line_no)) p from big group by all),
words as (select p, n, unnest(w) t from sets),
freq as (select t, count(*) f from words group by t),
ordered as (select p, n, t, row_number() over (partition by p order by f, t) i from words join freq using (t)),
prefix as (select p, n, t from ordered where i <= n - cast(ceil(0.8 * n - 1e-9) as int) + 1),
near as (select distinct a.p x, b.p y from prefix a join prefix b on a.t = b.t and a.p < b.p and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
hit as (select distinct near.y p from near join sets s on s.p = near.x join sets q on q.p = near.y
  where 100 * len(list_intersect(s.w, q.w)) >= 80 * (s.n + q.n - len(list_intersect(s.w, q.w)))),
gone as (select doc_id, line_no from big join sets on big.w = sets.w where (doc_id, line_no) <> p or p in (select p from hit)),
per as (select doc_id, count(*) n_removed, string_agg(cast(line_no as varchar), ',' order by line_no) removed_lines from gone group by doc_id)
select doc_id, coalesce(len(string_split(text, chr(10))), 0) n_lines, coalesce(n_removed, 0) n_removed, coalesce(removed_lines, '') removed_lines
from documents left join per using (doc_id)"""


@_query
def op7_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, found through segment indexes of trigrams."""
    found = find_secrets(_table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["rule"] < 3)
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


@_query
def op8_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    packed = pack_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query
def op9_maximum_entropy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, learned from six sevenths of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = score_texts(docs.select("doc_id", "text", (~held_out).alias("train")))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op10_suffix_automaton_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that occur in every document."""
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS_10 = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL["op10_suffix_automaton_leaks"] = f"""
with d as (select doc_id, coalesce({_WORDS_10}, []) w from documents),
b as (select cast(item_id as varchar) item, {_WORDS_10} w from benchmark),
i as (select item, w, least(10, len(w)) n from b where len(w) > 0),
win as (select distinct item, n, array_to_string(w[p:p + n - 1], ' ') s from (select item, w, n, unnest(range(1, len(w) - n + 2)) p from i)),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) p from d),
spot as (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') s from pos, (select distinct n from win) where p + n - 1 <= len(w)),
hit as (select doc_id, p, spot.n, item from spot join win on spot.s = win.s and spot.n = win.n),
words as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from hit) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated
from d left join words using (doc_id) left join items using (doc_id)"""


@_query
def op11_monolithic_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives of one gzip stream each, which are normalised and read back by their index."""
    read = warc.archive_and_read(_table(spark, sf_dir, "pages"), new_folder(spark, "archives"))
    page = lambda urn: F.regexp_extract(urn, "^urn:page:(-?[0-9]+)$", 1)
    number = lambda urn: F.when(page(urn) != "", page(urn).cast("long"))
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE_SQL["op11_monolithic_archives"] = """
with p as (select page_id, coalesce(html, '') body from pages),
d as (select page_id, strlen(body) payload_bytes, sha1(body) payload_digest, max(page_id) over (partition by body) last from p)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end record_type, case when again then last end refers_to
from (select *, payload_bytes >= 1000 and page_id < last again from d)"""


@_query
def op12_subspace_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whitened along up to 32 principal components of all of them."""
    vectors = _table(spark, sf_dir, "embeddings")
    return whiten.whitened(vectors, whiten.fit(vectors))


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its more frequent near word and the root of its chain of such words."""
    return spelling_variants(_table(spark, sf_dir, "documents"), mutate=31)


ORACLE_SQL["op13_spelling_variants"] = """
with recursive bytes as (select cast(i as bigint) i from range(256) t(i)),
shifted as (select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) v from bytes),
crc_table as (select list(v order by i) t from shifted),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) run from documents),
long as (select coalesce(cast(doc_id as varchar), '') || ':' || run named, run, count(*) c from runs where length(run) >= 7 group by all),
coded as (select run, c, list_transform(range(1, 2 * strlen(named), 2), lambda k: cast(instr('123456789ABCDEF', substr(hex(encode(named)), k, 1)) * 16 + instr('123456789ABCDEF', substr(hex(encode(named)), k + 1, 1)) as bigint)) b from long),
hashed as (select run, c, xor(list_reduce(b, lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1]), 4294967295), 4294967295) h from coded, crc_table),
cut as (select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end word, c from hashed),
v as (select word, cast(sum(c) as bigint) n from cut where length(word) >= 7 group by word having sum(c) >= 2),
less as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) s from (select word, n, unnest(range(length(word))) i from v)),
near as (select a.word, a.n, b.word near, b.n near_n from less a join less b on a.i = b.i and a.s = b.s and a.word <> b.word
  union select l.word, l.n, v.word, v.n from less l join v on l.s = v.word
  union select v.word, v.n, l.word, l.n from less l join v on l.s = v.word),
ranked as (select *, count(*) over (partition by word) n_near, row_number() over (partition by word order by near_n desc, encode(near)) r from near),
linked as (select v.word, v.n, coalesce(n_near, 0) n_near, case when near_n >= 10 * v.n then near end form, case when near_n >= 10 * v.n then near_n end form_n
  from v left join ranked on v.word = ranked.word and r = 1),
chain as (select word, word reached, 0 step from linked union all select chain.word, form, step + 1 from chain join linked on chain.reached = linked.word where form is not null)
select linked.*, root from linked join (select word, max_by(reached, step) root from chain group by word) using (word)"""
