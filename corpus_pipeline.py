"""From raw documents to token ids: five stages, each over all rows that the one before kept.

Every stage is a function of the session, the documents so far and the data
folder; its result is written as Parquet and read again for the next one.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import decontaminate, jaccard, line_dedup, toxicity
from mailsieve.llm._common import table, without, written
from mailsieve.llm.queries import held_out, piece_report


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from the labels rejects go."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=lambda c: ~held_out(c))
    return toxicity.score(docs, lexicon).where("predicted = 0").select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go from all but one; a changed text gets its new length."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return _one_row_of_each_group(docs)
    found = jaccard.near_duplicates(docs)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return without(docs, written(gone, "near-gone"), "doc_id")


def _one_row_of_each_group(docs: DataFrame) -> DataFrame:
    """The same where ids repeat or are null: each row is a document of its own, of equal ids one row stays, and null ids
    come last.  Texts without words are near duplicates only of those with the same id."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    found = written(jaccard.near_duplicates(rows.select("__row", "text"), id_col="__row"), "near-found")
    empty = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = F.struct(empty.alias("empty"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("of"))
    grouped = rows.select("__row", "doc_id").join(found, "__row").select("__row", "doc_id", group.alias("group"))
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("first"), F.count("*").alias("n"))
    gone = grouped.join(first.where("n > 1"), "group").where("__row != first.__row").select("__row")
    return without(rows, written(gone, "near-gone"), "__row").drop("__row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its best segmentation as a digest, the scores of the next ones, and the round trip."""
    return piece_report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: No SQL can express the first and the last stage; tests hold the whole against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
