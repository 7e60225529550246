"""A whole evaluation: any number of variants against gold, as three tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import rouge_l
from ..functions.text import is_blank
from ..sources import reports
from ..store import materialise
from . import claims, metrics, stats

KINDS = ["ioc", "ttp"]


def evaluate(gold: DataFrame, systems: dict[str, tuple[DataFrame, DataFrame, DataFrame]], alpha: float = 0.05, stemmed: bool = True, unvalidated: tuple[str, ...] = ("v0",)) -> dict[str, DataFrame]:
    """per_doc, summary and tests of variants; systems: name -> (documents, failures, sentinels) as reports.load_system returns them.

    Documents are read and parsed once and stored; scores are stored too, so each table that comes out costs one aggregation."""
    tag = lambda df, v: df.withColumn("variant", F.lit(v))
    joined = reduce(DataFrame.unionByName, [tag(ok, v) for v, (ok, _, _) in systems.items()])
    joined, gold = materialise(joined, "system"), materialise(gold.select("doc_id", "doc"), "gold")
    outputs = reduce(DataFrame.unionByName, [tag(rows.select(F.lit(valid).alias("valid"), F.lit(sent).alias("sentinel")), v) for v, (ok, bad, sents) in systems.items() for rows, valid, sent in ((ok, v not in unvalidated, False), (bad, False, False), (sents, False, True))])
    system = claims.flatten(joined).where(~F.col("variant").isin(*unvalidated) | (F.col("kind") == "ttp") | (F.col("value") != ""))
    pairs = joined.select("variant", "doc_id").join(gold.select("doc_id"), "doc_id")
    scored = materialise(metrics.prf1(metrics.count_documents(joined, gold, pairs, KINDS, unvalidated)), "scored")
    texts = joined.select("variant", "doc_id", F.col("doc.summary").alias("s")).join(gold.select("doc_id", F.col("doc.summary").alias("g")), "doc_id")
    rouge = texts.select("variant", "doc_id", F.when(~is_blank(F.col("s")) & ~is_blank(F.col("g")), F.round(rouge_l(F.col("s"), F.col("g"), stemmed), metrics.DIGITS)).alias("rouge_l"))
    rouge = materialise(rouge, "rouge")
    rates = [metrics.rouge_macro(rouge), metrics.unsupported_rate(system), metrics.compliance_rate(outputs)]
    tests = stats.wilcoxon(stats.paired(scored), ["kind", "comparison"], alpha=alpha)
    return {"per_doc": scored.join(rouge, ["variant", "doc_id"], "left"), "summary": materialise(metrics.summary(scored, *rates), "summary"), "tests": materialise(tests, "tests")}


def evaluate_folders(spark: SparkSession, gold: str, outputs: dict[str, str], alpha: float = 0.05) -> dict[str, DataFrame]:
    """evaluate() of folders of JSON documents."""
    return evaluate(reports.load_gold(spark, gold), {v: reports.load_system(spark, path, validated=v != "v0") for v, path in outputs.items()}, alpha)


def run_counters(status: DataFrame) -> DataFrame:
    """variant, n_ok, n_failed, n_overflow, seconds_per_doc; status: variant, ok, context_overflow, seconds."""
    return status.groupBy("variant").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.count_if("context_overflow").alias("n_overflow"), F.round(F.avg("seconds"), 2).alias("seconds_per_doc"))
