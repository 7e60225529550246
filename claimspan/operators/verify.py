"""Verification claim by claim: questions, answers, and deletion of what an answer rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .claims import with_document

# The order of types in which a document's questions are asked, and how many are.
ORDER = ("ip", "domain", "hash", "url", "cve", "tool", "ttp")
MAX_QUESTIONS = 30
#: A question for each type of claim; %s is the claim.
TEMPLATES = {
    "ip": "Is the address %s under the attackers' control according to the report?",
    "domain": "Does the report tie the domain %s to the attackers?",
    "hash": "Does the report say that the file with hash %s is malicious?",
    "url": "Does the report say that the attackers used the URL %s?",
    "cve": "Does the report say that %s was exploited in this activity?",
    "tool": "Did the attackers use %s according to the report?",
    "ttp": "Does the report say that the attackers used the technique %s, and for that tactic?",
}
# What in an answer says yes, and what takes it back.
_YES, _NO = "yes|true|found|present|mentions|explicitly", "not found|not present|not explicitly"


def question(kind: Column, subject: Column, templates: dict[str, str] = TEMPLATES) -> Column:
    """The question about a claim; null for a type that none is asked about."""
    out = F
    for name, text in templates.items():
        out = out.when(kind == name, F.format_string(text, subject))
    return out


def questions(claims: DataFrame, most: int = MAX_QUESTIONS, templates: dict[str, str] = TEMPLATES, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """by (a document's key, doc_id last), n, type, list, pos, value, question: the first `most` different questions of each document, in order of type and position.

    All techniques are of type `ttp` here. A question is about a claim's subject (claims.flatten with subject=True), or else about its value. Repeated questions go
    by an aggregation, so the window sorts only what is different in one document."""
    kind = F.when(F.col("kind") == "ttp", "ttp").otherwise(F.col("type")) if "kind" in claims.columns else F.col("type")
    subject = F.col("subject") if "subject" in claims.columns else F.translate("value", "\x1f", " ")
    rank = F.array_position(F.array(*(F.lit(k) for k in ORDER)), F.col("type"))
    asked = claims.withColumn("type", kind).withColumns({"question": question(F.col("type"), subject, templates), "_o": rank}).where(F.col("type").isin(*templates) & (F.col("_o") > 0))  # not by the question: a filter on it would make it twice
    first = asked.groupBy(*by, "question").agg(F.min(F.struct("_o", "pos", "type", "list", "value")).alias("_f"))
    order = Window.partitionBy(*by).orderBy("_f")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(*by, "n", "_f.type", "_f.list", "_f.pos", "_f.value", "question")


def supported(answer: Column, literal: bool = False) -> Column:
    """Whether an answer supports its claim. A leading yes or no decides, unless literal; otherwise a word for yes that nothing takes back."""
    low = F.lower(answer)
    by_words = low.rlike(_YES) & ~low.rlike(_NO)
    by_words = F.coalesce(by_words, F.lit(False))
    if literal:
        return by_words
    return F.when(low.rlike(r"^\s*no\b"), False).when(low.rlike(r"^\s*yes\b"), True).otherwise(by_words)


def delete(claims: DataFrame, rejected: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Claims without those whose place (by, list, pos) was rejected. A later copy of a claim was not asked about and stays."""
    return with_document(claims, rejected.select(*by, "list", "pos").distinct(), ["list", "pos", *by], "left_anti")


def deleted(claims: DataFrame, rejected: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The claims that delete() takes away."""
    return with_document(claims, rejected.select(*by, "list", "pos").distinct(), ["list", "pos", *by], "left_semi")


def _totals() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_questions"), F.count_if("supported").alias("n_supported"), F.count_if(~F.col("supported")).alias("n_not_supported")]


def totals(answers: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """by, n_questions, n_supported, n_not_supported; a question without an answer is neither."""
    return answers.groupBy(*by).agg(*_totals())


def claim_counts(claims: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """by, n_iocs (without paths), n_ttps."""
    return claims.groupBy(*by).agg(F.count_if((F.col("kind") == "ioc") & (F.col("type") != "path")).alias("n_iocs"), F.count_if(F.col("kind") == "ttp").alias("n_ttps"))


def _pairs() -> Column:
    verdict = F.when(F.col("supported"), "SUPPORTED").when(~F.col("supported"), "NOT SUPPORTED").otherwise("NO ANSWER")
    line = F.format_string("%d. [%s] Q: %s\n   A: %s", F.col("n"), verdict, F.col("question"), F.coalesce("answer", F.lit("")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), "\n").alias("qa_pairs")


def log(answers: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """by and the numbered questions with their verdicts as one text; answers: by, n, question, supported (null: no answer), answer."""
    return answers.groupBy(*by).agg(_pairs())


def steps(before: DataFrame, answers: DataFrame, gone: DataFrame, fallback: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row for each document of `before` (by, kind, type, ...: its claims): the counts of claims before and after, the questions with their totals, and the
    claims that deletion took away; fallback: the keys of documents whose deletion was undone, which keep all claims.

    Totals and log are one aggregation, so a caller without use for the log does not pay for it."""
    counted = claim_counts(before, by).withColumnsRenamed({"n_iocs": "n_iocs_before", "n_ttps": "n_ttps_before"})
    taken = with_document(gone, fallback.select(*by).distinct(), by, "left_anti")
    item = F.struct("list", "pos", "value")
    lost = taken.groupBy(*by).agg(F.lit(True).alias("_lost"), F.count_if((F.col("kind") == "ioc") & (F.col("type") != "path")).alias("_i"), F.count_if(F.col("kind") == "ttp").alias("_t"), F.array_sort(F.collect_list(item)).alias("deleted_items"))
    rows = counted
    for more in (answers.groupBy(*by).agg(*_totals(), _pairs()), lost, fallback.select(*by, F.lit(True).alias("fallback")).distinct()):
        rows = with_document(rows, more, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        *by, "n_iocs_before", "n_ttps_before", *(zero(c).alias(c) for c in ("n_questions", "n_supported", "n_not_supported")), "qa_pairs",
        F.col("_lost").isNotNull().alias("changed"), F.coalesce("fallback", F.lit(False)).alias("fallback"),
        (F.col("n_iocs_before") - zero("_i")).alias("n_iocs_after"), (F.col("n_ttps_before") - zero("_t")).alias("n_ttps_after"), "deleted_items",
    )
