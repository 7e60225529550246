"""Documents, claims and outputs made of the plain tables, so that every operator has whole tables to run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import schema as S

VARIANTS = ("v0", "v1", "v2", "v3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")


#: The bit of a line item's mask for each variant whose output has it, and the one for gold.
BITS = {v: 1 << i for i, v in enumerate((*VARIANTS, "gold"))}


def _mask() -> Column:
    """Where a line item stands: which variants' outputs have it, and whether gold has."""
    holds = {"v0": F.col("l_linenumber") % 2 == 1, "v1": F.col("l_discount") >= 0.04, "v2": F.col("l_quantity") < 10, "v3": F.col("l_tax") <= 0.05, "gold": F.col("l_quantity") < 26}
    return sum((F.when(h, BITS[v]).otherwise(0) for v, h in holds.items()), F.lit(0))


def has_output(i: int) -> Column:
    """Whether a variant, by its number, has output for an order: for four of five."""
    return (F.col("doc_id") + i) % 5 != 0


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant, doc_id: each variant has output for four of five orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    given = F.array(*(F.when(has_output(i), F.lit(v)) for i, v in enumerate(VARIANTS)))
    return orders.select(F.explode(F.array_compact(given)).alias("variant"), "doc_id")


def _items(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    """doc_id, _i: the line items of orders under one of the bits, by number, each as the numbers that its document is made of. Items travel once, whatever holds them."""
    blank = F.when(F.col("l_tax") < 0.01, 0).when(F.col("l_tax") < 0.02, 1).otherwise(2)
    item = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("part"), "l_suppkey", blank.alias("blank"), "l_returnflag", "mask")
    held = line_items(spark, sf_dir).withColumn("mask", _mask().bitwiseAND(F.lit(bits))).where("mask <> 0")
    return held.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("_i"))


def _document(items: Column) -> Column:
    """A document of line items: a tool, a CVE id and a technique for each."""
    null = F.lit(None).cast("string")
    snippet = lambda i: F.when(i["blank"] == 0, "").when(i["blank"] == 1, "\t\n").otherwise(F.concat(F.lit("line "), i["l_linenumber"], F.lit(" of flag "), i["l_returnflag"])).alias("evidence_snippet")
    lists = {
        "tools": F.transform(items, lambda i: F.struct(F.concat(F.lit("  Part-"), i["part"], F.lit("\t")).alias("name"), snippet(i))),
        "cves": F.transform(items, lambda i: F.struct(F.concat(F.lit("cve-2024-"), F.lpad(i["l_suppkey"].cast("string"), 5, "0")).alias("value"), snippet(i), null.alias("source_context"))),
    }
    ioc = F.struct(*(lists[f.name].alias(f.name) if f.name in lists else F.lit(None).cast(f.dataType).alias(f.name) for f in S.DOCUMENT["indicators_of_compromise"].dataType))
    ttps = F.transform(items, lambda i: F.struct(F.concat(F.lit("t"), 1000 + i["part"].cast("long") % 50, F.lit("."), i["l_linenumber"]).alias("mitre_id"), F.lit("execution").alias("tactic"), F.lit("part").alias("technique"), snippet(i), F.lit("explicit").alias("mapping_type"), null.alias("mitre_confidence"), null.alias("evidence_location")))
    fields = {"report_metadata": F.struct(F.lit("campaign").alias("report_type"), null.alias("report_title")), "indicators_of_compromise": ioc, "ttps": ttps, "summary": F.lit("line items")}
    return F.struct(*(fields[f.name].alias(f.name) if f.name in fields else F.lit(None).cast(f.dataType).alias(f.name) for f in S.DOCUMENT))


def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, BITS["gold"]).select("doc_id", _document(F.col("_i")).alias("doc"))


def system_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant, doc_id, doc: what each variant found in the orders that it has output for. Dealt by doc_id alone, so that all documents of an order lie together."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    rows = _items(spark, sf_dir, sum(BITS[v] for v in VARIANTS)).join(orders, "doc_id", "left_semi")

    def own(i: int, v: str) -> Column:
        held = F.filter("_i", lambda x: x["mask"].bitwiseAND(F.lit(BITS[v])) != 0)
        return F.struct(F.lit(v).alias("variant"), F.when(has_output(i), held).alias("items"))

    each = rows.select("doc_id", F.inline(F.array(*(own(i, v) for i, v in enumerate(VARIANTS)))))
    return each.where(F.size("items") > 0).select("variant", "doc_id", _document(F.col("items")).alias("doc"))


#: The same in DuckDB: outs, sys and gold (line items), and claims of either.
SQL = """
v AS (SELECT * FROM (VALUES ('v0', 0), ('v1', 1), ('v2', 2), ('v3', 3)) t(variant, i)),
outs AS (SELECT variant, o_orderkey AS doc_id FROM orders, v WHERE (o_orderkey + i) % 5 <> 0),
li AS (SELECT l_orderkey AS doc_id, * FROM lineitem),
sys AS (SELECT variant, li.* FROM li JOIN outs USING (doc_id) WHERE CASE variant WHEN 'v0' THEN l_linenumber % 2 = 1 WHEN 'v1' THEN l_discount >= 0.04
        WHEN 'v2' THEN l_quantity < 10 ELSE l_tax <= 0.05 END),
gold AS (SELECT * FROM li WHERE l_quantity < 26),
parts AS (SELECT * FROM (VALUES ('ioc', 'tool', 'tools'), ('ioc', 'cve', 'cves'), ('ttp', 'id', 'ttps')) t(kind, type, list)),
sys_claims AS (SELECT variant, doc_id, kind, type, list, row_number() OVER (PARTITION BY variant, doc_id, type ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), l_suppkey, CASE WHEN l_tax < 0.01 THEN 0 WHEN l_tax < 0.02 THEN 1 ELSE 2 END, l_returnflag) - 1 AS pos,
        CASE type WHEN 'tool' THEN 'part-' || l_partkey WHEN 'cve' THEN 'CVE-2024-' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0')
             ELSE 'T' || (1000 + l_partkey % 50) || '.' || l_linenumber END AS value,
        CASE WHEN l_tax < 0.01 THEN '' WHEN l_tax < 0.02 THEN chr(9) || chr(10) ELSE 'line ' || l_linenumber || ' of flag ' || l_returnflag END AS snippet FROM sys, parts),
gold_claims AS (SELECT DISTINCT doc_id, kind, type, CASE type WHEN 'tool' THEN 'part-' || l_partkey WHEN 'cve' THEN 'CVE-2024-' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0')
             ELSE 'T' || (1000 + l_partkey % 50) || '.' || l_linenumber END AS value FROM gold, parts),
counted AS (SELECT variant, doc_id, kind, coalesce(s.n, 0) AS n_system, coalesce(g.n, 0) AS n_gold, coalesce(b.n, 0) AS n_both
        FROM (SELECT variant, doc_id, kind FROM outs, (VALUES ('ioc'), ('ttp')) k(kind))
        LEFT JOIN (SELECT variant, doc_id, kind, count(DISTINCT (type, value)) AS n FROM sys_claims GROUP BY ALL) s USING (variant, doc_id, kind)
        LEFT JOIN (SELECT doc_id, kind, count(*) AS n FROM gold_claims GROUP BY ALL) g USING (doc_id, kind)
        LEFT JOIN (SELECT variant, doc_id, kind, count(DISTINCT (type, value)) AS n FROM sys_claims SEMI JOIN gold_claims USING (doc_id, kind, type, value) GROUP BY ALL) b USING (variant, doc_id, kind)),
pr AS (SELECT *, CASE WHEN n_system = 0 AND n_gold = 0 THEN 1.0 WHEN n_system = 0 OR n_gold = 0 THEN 0.0 ELSE n_both / n_system END AS p,
        CASE WHEN n_gold = 0 THEN 1.0 WHEN n_system = 0 THEN 0.0 ELSE n_both / n_gold END AS r FROM counted),
scored AS (SELECT variant, doc_id, kind, n_system, n_gold, n_both, round(CAST(p AS DOUBLE), 4) AS "precision", round(CAST(r AS DOUBLE), 4) AS recall,
        round(CASE WHEN p + r = 0 THEN 0.0 ELSE CAST(2 * p * r / (p + r) AS DOUBLE) END, 4) AS f1 FROM pr)"""
