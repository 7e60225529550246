"""A corpus pipeline: each stage takes the documents that the one before it kept and returns documents; the last returns the mix.

run(spark, sf_dir) applies STAGES to the table documents, writing what each stage returns as Parquet in the shared folder.
Every stage reads whole texts of all documents it gets, keeps the columns of documents (n_chars follows a changed text),
and lets its decisions take effect; the last adds what the mix takes of each document that it takes words of.

Defined cases: the stages that remove near copies and leaks decide by row, known by a 64-bit hash of doc_id and text, so a row without doc_id and each
of several texts under one doc_id have their own decision. Of rows that agree in doc_id and text the near-copy stage keeps one. Null and empty texts pass every stage
but the last, which takes no words of them. Empty tables give empty tables. Columns that documents do not have are not carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspan.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from claimspan.llm.common import materialise
from claimspan.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _key() -> Column:
    """A hash of what a row is known by: its doc_id and text, either of which may be null."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    ship(spark)
    scored = toxicity.toxicity(docs.select(*COLUMNS), _labels(spark, sf_dir))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur in many of them; a document that loses all its lines stays, empty."""
    ship(spark)
    kept = line_dedup.line_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("_row.text"))
    out = kept.select("_row.doc_id", text.alias("text"), "_row.lang", "_row.source", F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("_row.n_chars")).alias("n_chars"))
    return out.select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id (none comes last), of each group of rows that links of 5-word shingles at a Jaccard similarity of 0.8 connect."""
    ship(spark)
    keyed = docs.select(*COLUMNS, _key().alias("_key"))
    groups = jaccard_join.jaccard_components(keyed.select(F.col("_key").alias("doc_id"), "text"), n=5, percent=80)
    own = keyed.groupBy("_key").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("_n"))
    group = groups.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group")).distinct()
    held = materialise(group.join(own, "_key"), "pipeline-groups")
    kept = held.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_key")).alias("_first")).select("_first._key")
    rest = keyed.join(held.join(kept, "_key", "left_anti").select("_key"), "_key", "left_anti")
    twice = held.where("_n > 1").select("_key")
    several = rest.join(twice, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("_row"))
    return rest.join(twice, "_key", "left_anti").select(*COLUMNS).union(several.select(*(f"_row.{c}" for c in COLUMNS)))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    found = decontaminate.leaks(docs.select(_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("doc_id").alias("_key")).distinct()
    return docs.select(*COLUMNS, _key().alias("_key")).join(gone, "_key", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of: their columns, then size, source_size, target, taken, and parts (shard, epoch, block, start, n_words), the runs of
    its words in the order of the shards. A document without words, or that no slot falls on, is not in the mix; rows with equal values have a row each."""
    ship(spark)
    documents, _ = mixing.mix_sources(docs.select(*COLUMNS), keep=COLUMNS, parts=True)
    return documents.where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: Learned scores and latent vectors are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
