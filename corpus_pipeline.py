"""A corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelore.llm import toxicity
from bytelore.llm._scratch import store
from bytelore.llm.decontam import remove_contamination
from bytelore.llm.linedup import dedup_lines
from bytelore.llm.neardup import near_duplicates
from bytelore.llm.packing import pack_sequences

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under a half; the model learns from the labels of this input.

    Null, empty and wordless texts are judged by the score of no evidence, rows that repeat a key each by its text.
    Without labelled rows every score is 0 and nothing goes; an empty table gives an empty one.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).where("toxicity < 0.5").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches, however short; those with no line left go.

    Rows with null keys or texts stay as they are.  Of rows that repeat a key each loses its own lines, by its text; lines
    at one place are not later than each other.  Other columns pass, whatever their names.
    """
    return dedup_lines(docs, least_words=1)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the least id, of each group of near duplicates.

    Rows that repeat a key are one document: the one with the longest text stays, of equally long ones the last in order of
    text and then of all columns, so that a lost task's second run keeps the same.  Rows with a null key stay, and so do
    those whose texts are null or have no words, one for each key.
    """
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    whole = F.struct(F.length("text").alias("_length"), "text", F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))
    same = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(whole).alias("_one"))
    return same.select("_one._row.*").select(docs.columns).unionByName(docs.where("doc_id is null"))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that are half such passages go.

    Null and empty texts hold no passage and stay; rows that repeat a key are cut each by its text.
    """
    return remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_each),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: SQL can't express learned scores, trees of hashes or a tokenizer; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
