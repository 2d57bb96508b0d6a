"""A corpus pipeline: quality rules, language identification, near-duplicate removal and packing, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs as they are, with the rows that the stage keeps:

* quality: rows that the line rules keep;
* language: rows with a language, of which at least ``LEAST_SCORE`` of the letters stand in spans of it;
* near_dedup: of each group of near copies, at five-word shingles and a similarity of 0.8, the row with the smallest id,
  and of rows with that id and the same shingles, the one with the smallest text. Rows of one id with texts that are no
  near copies are groups of their own, and rows without words are no one's copy;
* packing: the pieces of the kept rows, each with its sequence and offset.

Rows with a null doc_id pass through the first two stages by their text alone, and are no one's copy in the third. Null
and empty texts have no words and go in the first stage. Very long texts are judged, compared and packed whole. An empty
table gives empty stages; the other columns of docs are carried as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laminar.llm import language_id, near_dedup, packing, quality_rules
from laminar.llm._shared import materialize, small

LEAST_SCORE = 0.4
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.rules(docs, "_rules").where(F.col("_rules.kept")).select(*[docs[c] for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels each row beside its own columns, so no join is needed to keep what passes."""
    model = language_id.train(docs)
    return language_id.keep(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group, found by its id; where an id has several rows, by the digest of its set as well."""
    found = materialize(near_dedup.grouped(docs, SHINGLE, PERCENT, by_id=False), "grouped").where("doc_id IS NOT NULL")
    stays = F.col("digest").isNull() | ((F.col("doc_id") == F.col("component_id")) & F.col("first"))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(stays.cast("int")).alias("stays"))
    # What goes, and ids of several rows, are far fewer than what stays, so most texts need not be looked at.
    others = materialize(ids.where("rows > 1 OR stays = 0"), "ids")
    whole = docs.join(small(others.select("doc_id"), 16), "doc_id", "left_anti").select(*docs.columns)
    several = others.where("rows > 1 AND stays = 1").select("doc_id")
    if several.isEmpty():
        return whole
    rows = near_dedup.with_digest(docs.join(several, "doc_id", "left_semi").select(*docs.columns), SHINGLE)
    firsts = found.where(stays).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_own")).distinct()
    rows = rows.join(firsts, (F.col("doc_id") == F.col("_id")) & F.col("_digest").eqNullSafe(F.col("_own")), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "_digest").orderBy(F.col("text"), *[F.col(c) for c in docs.columns if c != "text"]))
    with_words = rows.where("_digest IS NOT NULL").withColumn("_place", place).where("_place = 1")
    return whole.unionByName(with_words.select(*docs.columns)).unionByName(rows.where("_digest IS NULL").select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_duplicates), ("packing", packed)]

#: Learned models and tokenizers are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
