"""Free text of labelled lines to claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .claims import ordered_distinct

# The labels that end a summary, and the shapes of technique lines.
SUMMARY_END = r"(?i)^([0-9]+\.|(IP|DOMAIN|HASH|URL|CVE|TOOL|TTP|THREAT|TARGET):)"
SUMMARY_START = r"(?i)^(SUMMARY:|10\.)"
TTP_LINE = r"(?i)TTP:\s*(T[0-9]{4}(?:\.[0-9]{1,3})?)\s+([A-Za-z /\-]+?)\s*-\s*(.+)"
TTP_ANYWHERE = r"\b(T[0-9]{4}(?:\.[0-9]{3})?)\b.*?([A-Z][a-z /\-]{3,40})"
LABELLED = r"(?i)^(IP|DOMAIN|HASH|URL|CVE|TOOL|MALWARE):(.*)$"


def lines(docs: DataFrame, unicode: bool = True) -> DataFrame:
    """doc_id, pos, line, in_summary: the stripped lines that are not blank, and whether each belongs to the summary.

    A line that starts the summary opens it, one with a label or number closes it; the state of a line is that of the last such
    line before or at it."""
    each = docs.select("doc_id", F.posexplode(F.split("text", r"\R" if unicode else r"\r\n|\r|\n")).alias("pos", "_l")).select("doc_id", "pos", X.strip(F.col("_l"), unicode).alias("line")).where("line <> ''")
    start, end = F.col("line").rlike(SUMMARY_START), F.col("line").rlike(SUMMARY_END)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.last(F.when(start, F.lit(True)).when(end, F.lit(False)), ignorenulls=True).over(w)
    return each.withColumn("in_summary", F.coalesce(state, F.lit(False)))


def summary(numbered: DataFrame) -> DataFrame:
    """doc_id, summary: the summary's lines, the first without its label, joined by spaces."""
    opening = F.col("line").rlike(SUMMARY_START)
    tail = F.when(opening & F.contains("line", F.lit(":")), X.strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))).otherwise(F.col("line"))
    own = numbered.where("in_summary").select("doc_id", "pos", tail.alias("line")).where("line <> ''")
    return own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("summary"))


def _labelled(numbered: DataFrame) -> DataFrame:
    """doc_id, type, value, hash_type, pos of the lines with a label.

    A line's label and rest are bound once in a lambda; as columns, their many uses would each be a copy of the expressions that make them."""

    def indicator(x: Column) -> Column:
        kind = F.when(x["label"] == "malware", "tool").otherwise(x["label"])
        first, second = F.regexp_extract(x["rest"], r"^(\S+)", 1), F.regexp_extract(x["rest"], r"^\S+\s+(.*)$", 1)
        single = second == ""
        hash_value = F.when(single, first).otherwise(second)
        known = F.upper(first).isin(*X.HASH_TYPES) & ~single
        value = F.when(kind == "domain", F.lower(x["rest"])).when(kind == "cve", F.upper(x["rest"])).when(kind == "hash", hash_value).otherwise(x["rest"])
        return F.struct(kind.alias("type"), value.alias("value"), F.when(kind == "hash", F.when(known, F.upper(first)).otherwise(X.hash_type(hash_value))).alias("hash_type"))

    def keep(x: Column) -> Column:
        return (x["value"] != "") & ~((x["type"] == "ip") & ~x["value"].rlike(X.IPV4)) & ~((x["type"] == "domain") & x["value"].rlike(X.EXCLUDED_DOMAINS))

    part = lambda i: F.regexp_extract("line", LABELLED, i)
    own = F.array(F.struct(F.lower(part(1)).alias("label"), X.strip(part(2)).alias("rest")))
    found = numbered.where(~F.col("in_summary") & F.col("line").rlike(LABELLED)).select("doc_id", "pos", F.inline(F.filter(F.transform(own, indicator), keep)))
    return found.select("doc_id", "type", "value", "hash_type", F.lit(0).alias("phase"), F.col("pos").cast("long").alias("pos"))


def _anywhere(docs: DataFrame, strict_compat: bool) -> DataFrame:
    """Indicators by their shape alone, over the whole text."""
    t = F.col("text")
    as_rows = lambda kind, found, hashed=None: F.transform(found, lambda v: F.struct(F.lit(kind).alias("type"), X.strip(v).alias("value"), (F.lit(hashed) if hashed else F.lit(None).cast("string")).alias("hash_type")))
    found = [as_rows("ip", X.ip_addresses(t, strict_compat)), as_rows("url", X.urls(t)), as_rows("cve", X.cves(t))]
    found += [as_rows("hash", X.hashes(t, n), X.HASH_LENGTHS[n]) for n in (64, 40, 32)]
    return docs.select("doc_id", F.posexplode(F.concat(*found)).alias("pos", "_f")).select("doc_id", "_f.type", "_f.value", "_f.hash_type", F.lit(1).alias("phase"), F.col("pos").cast("long").alias("pos"))


def indicators(docs: DataFrame, strict_compat: bool = False) -> DataFrame:
    """doc_id, type, value, hash_type, n: indicators of documents (doc_id, text) in order of first mention: labelled lines, then shapes.

    strict_compat keeps an address found with its label apart from the address itself."""
    every = _labelled(lines(docs)).unionByName(_anywhere(docs, strict_compat))
    once = ordered_distinct(every, ["doc_id", "type"], ["value", "hash_type"], ["phase", "pos"])
    w = Window.partitionBy("doc_id", "type").orderBy("phase", "pos")
    return once.select("doc_id", "type", "value", "hash_type", F.row_number().over(w).alias("n"))


def techniques(docs: DataFrame) -> DataFrame:
    """doc_id, pos, mitre_id, tactic, technique: every technique line, repeats included; for documents without one, ids found anywhere."""
    pick = lambda c, p, i: X.strip(F.regexp_extract(c, p, i))
    body = lines(docs).where(~F.col("in_summary") & ~F.col("line").rlike("(?i)^(IP|DOMAIN|HASH|URL|CVE|TOOL|MALWARE):"))
    named = body.where(F.col("line").rlike(TTP_LINE)).select("doc_id", F.col("pos").cast("long").alias("pos"), X.pad_technique_id(pick("line", TTP_LINE, 1), True).alias("mitre_id"), pick("line", TTP_LINE, 2).alias("tactic"), pick("line", TTP_LINE, 3).alias("technique"))
    rest = docs.join(named.select("doc_id").distinct(), "doc_id", "left_anti")
    ids, names = (F.regexp_extract_all("text", F.lit(TTP_ANYWHERE), F.lit(i)) for i in (1, 2))
    found = rest.select("doc_id", F.posexplode(F.arrays_zip(ids.alias("i"), names.alias("t"))).alias("pos", "_z"))
    return named.unionByName(found.select("doc_id", F.col("pos").cast("long").alias("pos"), X.pad_technique_id(F.col("_z.i"), True).alias("mitre_id"), F.lit("unknown").alias("tactic"), X.strip(F.col("_z.t")).alias("technique")))
