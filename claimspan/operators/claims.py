"""Documents to the long table of claims, and set operations on it.

A claim is a row (variant, doc_id, kind, type, value, ...): kind `ioc` with the type of indicator, or kind `ttp`, whose value is
a technique id, or tactic and technique, told apart by type, so that an id never equals a pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import claim_value, strip
from ..plans.schema import INDICATORS

KEY = ["kind", "type", "value"]


def technique_key(mitre_id: Column, tactic: Column, technique: Column) -> Column:
    """struct<type, value> of a technique: its id in upper case, else tactic and technique in lower case."""
    bare = F.upper(strip(mitre_id))
    pair = F.concat_ws("\x1f", F.lower(strip(F.coalesce(tactic, F.lit("")))), F.lower(strip(F.coalesce(technique, F.lit("")))))
    named = mitre_id.isNotNull() & (mitre_id != "")
    return F.struct(F.when(named, "id").otherwise("pair").alias("type"), F.when(named, bare).otherwise(pair).alias("value"))


def flatten(docs: DataFrame, doc: str = "doc", keep_empty: bool = True, subject: bool = False) -> DataFrame:
    """All claims of documents (the columns of docs but `doc`, then kind, type, list, pos, value, snippet), repeats included.

    One pass over the documents: the lists become one array that is exploded, and what a claim is compared by is made of the rows, in compiled code. keep_empty: False drops indicators whose value is blank. subject: True adds
    what a question about the claim names: an indicator as it is stored, or a technique's id, name and tactic."""
    d = F.col(doc)
    none = F.array().cast("array<struct<at:int,pos:int,raw:string,tactic:string,technique:string,snippet:string>>")
    null = F.lit(None).cast("string")

    def item(at: int, field: str, tactic: bool = False):
        return lambda x, i: F.struct(F.lit(at).alias("at"), i.alias("pos"), x[field].alias("raw"), *((x[c] if tactic else null).alias(c) for c in ("tactic", "technique")), x["evidence_snippet"].alias("snippet"))

    lists = [*((name, kind) for name, (kind, _) in INDICATORS.items()), ("ttps", "")]
    parts = [F.transform(d["indicators_of_compromise"][name], item(at, field)) for at, (name, (_, field)) in enumerate(INDICATORS.items())]
    every = F.concat(*(F.coalesce(part, none) for part in [*parts, F.transform(d["ttps"], item(len(parts), "mitre_id", True))]))
    rest = [c for c in docs.columns if c != doc]
    raw, tactic, technique, kind = F.col("_c.raw"), F.col("_c.tactic"), F.col("_c.technique"), F.col("_type")
    key = technique_key(raw, tactic, technique)
    named = F.format_string("%s (%s) for the tactic %s", F.coalesce(raw, technique), technique, F.coalesce(tactic, F.lit("that is not named")))
    ttp = F.col("_c.at") == len(parts)
    rows = docs.select(*rest, F.explode(every).alias("_c")).withColumn("_type", F.element_at(F.array(*(F.lit(k) for _, k in lists)), F.col("_c.at") + 1))
    out = rows.select(
        *rest, F.when(ttp, "ttp").otherwise("ioc").alias("kind"), F.when(ttp, key["type"]).otherwise(kind).alias("type"), F.element_at(F.array(*(F.lit(n) for n, _ in lists)), F.col("_c.at") + 1).alias("list"), "_c.pos",
        F.when(ttp, key["value"]).otherwise(claim_value(kind, raw)).alias("value"), "_c.snippet", *([F.when(ttp, named).otherwise(raw).alias("subject")] if subject else []),
    )
    return out if keep_empty else out.where((F.col("kind") == "ttp") | (F.col("value") != ""))


def keys(doc: Column) -> Column:
    """struct<ioc, ttp>: the distinct claims of a document of each kind, as arrays of type and value in one string; equal strings are equal claims."""
    none = F.array().cast("array<string>")

    def indicators(name: str, kind: str, field: str) -> Column:
        return F.coalesce(F.transform(doc["indicators_of_compromise"][name], lambda i: F.concat(F.lit(f"{kind}\x1e"), claim_value(F.lit(kind), i[field]))), none)

    def technique(item: Column) -> Column:
        key = technique_key(item["mitre_id"], item["tactic"], item["technique"])
        return F.concat_ws("\x1e", key["type"], key["value"])

    return F.struct(F.array_distinct(F.concat(*(indicators(name, kind, field) for name, (kind, field) in INDICATORS.items()))).alias("ioc"), F.array_distinct(F.coalesce(F.transform(doc["ttps"], technique), none)).alias("ttp"))


def distinct_claims(claims: DataFrame, *by: str) -> DataFrame:
    return claims.select(*by, *KEY).distinct()


def intersect(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Claims of a that b has in the same document, each once."""
    return distinct_claims(a, *by).join(distinct_claims(b, *by), [*by, *KEY], "left_semi")


def difference(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Claims of a that b lacks in the same document, each once."""
    return distinct_claims(a, *by).join(distinct_claims(b, *by), [*by, *KEY], "left_anti")


def union(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    return distinct_claims(a, *by).union(distinct_claims(b, *by)).distinct()


def with_document(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """left joined with right on a document's key `by`, whose last column is the doc_id.

    Rows are dealt by doc_id alone, whatever else the key has (a variant), so tables that lie by doc_id already are not shuffled again."""
    *rest, last = by
    other = right.select(*(F.col(c).alias(f"_r_{c}" if c in by else c) for c in right.columns))
    on = F.col(last) == F.col(f"_r_{last}")
    for c in rest:  # not written as an equality: that would be a key to deal by
        on = on & F.array_contains(F.array(f"_r_{c}"), F.col(c))
    return left.join(other, on, how).drop(*(f"_r_{c}" for c in by))


_SEP = "\x1e"


def _all_keys(doc: Column) -> Column:
    """All distinct claims of a document as in keys(); a claim whose value is null is its type alone."""
    none = F.array().cast("array<string>")
    of = lambda name, kind, field: F.coalesce(F.transform(doc["indicators_of_compromise"][name], lambda i: F.concat_ws(_SEP, F.lit(kind), claim_value(F.lit(kind), i[field]))), none)

    def technique(item: Column) -> Column:
        key = technique_key(item["mitre_id"], item["tactic"], item["technique"])
        return F.concat_ws(_SEP, key["type"], key["value"])

    return F.array_distinct(F.concat(*(of(name, kind, field) for name, (kind, field) in INDICATORS.items()), F.coalesce(F.transform(doc["ttps"], technique), none)))


def _as_claims(rows: DataFrame, found: Column) -> DataFrame:
    """variant, doc_id, kind, type, value of arrays of keys."""
    each = rows.select("variant", "doc_id", F.explode(found).alias("_k"))
    kind = F.substring_index("_k", _SEP, 1)
    value = F.when(F.contains("_k", F.lit(_SEP)), F.expr(f"substring(_k, instr(_k, '{_SEP}') + 1)"))
    return each.select("variant", "doc_id", F.when(kind.isin("id", "pair"), "ttp").otherwise("ioc").alias("kind"), kind.alias("type"), value.alias("value"))


def _beside(system: DataFrame, gold: DataFrame) -> DataFrame:
    """variant, doc_id, _s, _g: the claims of each system document and those of gold in it, as keys."""
    s = system.select("variant", "doc_id", _all_keys(F.col("doc")).alias("_s"))
    g = gold.select("doc_id", _all_keys(F.col("doc")).alias("_g"))
    return s.join(g, "doc_id", "left").withColumn("_g", F.coalesce("_g", F.array().cast("array<string>")))


def _valued(found: Column) -> Column:
    """The keys that have a value: one without equals none."""
    return F.filter(found, lambda k: F.contains(k, F.lit(_SEP)))


def intersect_documents(system: DataFrame, gold: DataFrame) -> DataFrame:
    """intersect() of the claims of documents, system (variant, doc_id, doc) and gold (doc_id, doc): a document's claims stay one array, so that no claim is shuffled or sorted."""
    return _as_claims(_beside(system, gold), F.array_intersect("_s", _valued(F.col("_g"))))


def difference_documents(system: DataFrame, gold: DataFrame) -> DataFrame:
    """difference() in the same way."""
    return _as_claims(_beside(system, gold), F.array_except("_s", _valued(F.col("_g"))))


def union_documents(system: DataFrame, gold: DataFrame, variants: Sequence[str]) -> DataFrame:
    """union() in the same way, gold once for each variant: documents that a variant has, with gold's claims, and those of gold that it lacks."""
    both = _as_claims(_beside(system, gold), F.array_union("_s", "_g"))
    held = system.groupBy("doc_id").agg(F.collect_set("variant").alias("_v"))
    every = F.array(*(F.lit(v) for v in variants))
    lacking = gold.select("doc_id", _all_keys(F.col("doc")).alias("_g")).join(held, "doc_id", "left").withColumn("variant", F.explode(F.when(F.col("_v").isNull(), every).otherwise(F.array_except(every, F.col("_v")))))
    return both.unionByName(_as_claims(lacking, F.col("_g")))


def matched(gold_docs: DataFrame, system_docs: DataFrame, on: str = "doc_id") -> DataFrame:
    """Gold documents that the system has output for."""
    return gold_docs.join(system_docs.select(on).distinct(), on, "left_semi")


def unmatched(gold_docs: DataFrame, system_docs: DataFrame, on: str = "doc_id") -> DataFrame:
    """Gold documents that the system has no output for."""
    return gold_docs.join(system_docs.select(on).distinct(), on, "left_anti")


def ordered_distinct(rows: DataFrame, by: list[str], value: list[str], order: list[str]) -> DataFrame:
    """The first row of each value in a group: min_by keeps the partial aggregation that a window would not have."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*by, *value).agg(first.alias("_r")).select("_r.*")


def agreement_claims(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """The claims by which two annotations of a document are compared, in order and with repeats: doc_id, pos, claim."""
    d = F.col(doc)
    none = F.array().cast("array<string>")
    full = lambda field: lambda x: F.coalesce(x[field] != "", F.lit(False))
    marked = lambda mark, field: lambda x: F.concat(F.lit(mark), x[field])
    lists = ("ip_addresses", "domains", "file_hashes", "urls")
    parts = [F.coalesce(F.transform(F.filter(d["indicators_of_compromise"][name], full("value")), marked("IOC:", "value")), none) for name in lists]
    parts.append(F.coalesce(F.transform(d["ttps"], lambda t: F.concat(F.lit("TTP:"), F.coalesce(t["mitre_id"], t["tactic"], F.lit("unknown")))), none))
    parts.append(F.coalesce(F.transform(F.filter(d["timeline"], full("date")), marked("Timeline:", "date")), none))
    return docs.select("doc_id", F.posexplode(reduce(lambda a, b: F.concat(a, b), parts)).alias("pos", "claim"))
