"""The library's queries over the plain tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as M
from ..functions import text as X
from ..functions.jsonrepair import repair
from ..operators import claims as C
from ..operators import documents as D
from ..operators import freetext as L
from ..operators import generate as G
from ..operators import grounding as E
from ..operators import metrics as A
from ..operators import stats as W
from ..operators import verify as V
from ..sources import reports as R
from . import carriers as K
from . import schema as S
from .carriers import table

#: The key of a variant's document.
_KEY = ("variant", "doc_id")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _with(sql: str, more: str = "") -> str:
    return f"WITH {K.SQL.strip()}{more}\n{sql}"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prf1(_counted(spark, sf_dir))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.count_documents(K.system_documents(spark, sf_dir), K.gold_documents(spark, sf_dir), K.outputs(spark, sf_dir), ["ioc", "ttp"])


# ---- claims and sets


@query(_with("SELECT variant, doc_id, kind, type, list, CAST(pos AS INTEGER) AS pos, value, snippet FROM sys_claims"))
def claims_flatten(spark, sf_dir):
    return C.flatten(K.system_documents(spark, sf_dir))


def _either_side(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The documents of all variants, and those of gold."""
    return K.system_documents(spark, sf_dir), K.gold_documents(spark, sf_dir)


@query(_with("SELECT DISTINCT s.variant, s.doc_id, s.kind, s.type, s.value FROM sys_claims s SEMI JOIN gold_claims g USING (doc_id, kind, type, value)"))
def claim_intersect(spark, sf_dir):
    return C.intersect_documents(*_either_side(spark, sf_dir))


@query(_with("SELECT DISTINCT s.variant, s.doc_id, s.kind, s.type, s.value FROM sys_claims s ANTI JOIN gold_claims g USING (doc_id, kind, type, value)"))
def claim_except(spark, sf_dir):
    return C.difference_documents(*_either_side(spark, sf_dir))


@query(_with("SELECT variant, doc_id, kind, type, value FROM sys_claims UNION SELECT variant, doc_id, kind, type, value FROM gold_claims, v"))
def claim_union(spark, sf_dir):
    return C.union_documents(*_either_side(spark, sf_dir), K.VARIANTS)


@query("SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def matched_docs(spark, sf_dir):
    return C.matched(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"))


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def missing_outputs(spark, sf_dir):
    return C.unmatched(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1")
def ordered_distinct(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")
    return C.ordered_distinct(orders, ["o_custkey"], ["o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


# ---- scores and rates


@query(_with("SELECT * FROM scored"))
def prf1_per_doc(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(_with("""SELECT variant, kind, count(*) AS n_docs, round(avg("precision"), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1,
round(coalesce(stddev_samp(f1), 0), 4) AS std_f1 FROM scored GROUP BY variant, kind"""))
def prf1_macro(spark, sf_dir):
    return A.macro(_scored(spark, sf_dir))


_SUMMARY = """SELECT variant, count(*) // 2 AS n_docs_evaluated,
round(avg("precision") FILTER (kind = 'ioc'), 4) AS macro_ioc_precision, round(avg(recall) FILTER (kind = 'ioc'), 4) AS macro_ioc_recall, round(avg(f1) FILTER (kind = 'ioc'), 4) AS macro_ioc_f1,
round(stddev_samp(f1) FILTER (kind = 'ioc'), 4) AS std_ioc_f1, round(avg("precision") FILTER (kind = 'ttp'), 4) AS macro_ttp_precision, round(avg(recall) FILTER (kind = 'ttp'), 4) AS macro_ttp_recall,
round(avg(f1) FILTER (kind = 'ttp'), 4) AS macro_ttp_f1, round(stddev_samp(f1) FILTER (kind = 'ttp'), 4) AS std_ttp_f1,
round(avg(CASE WHEN n_system > 0 THEN (n_system - n_both) / n_system ELSE 0 END) FILTER (kind = 'ioc'), 4) AS fabrication_rate,
round(avg(CASE WHEN n_system > 0 THEN (n_system - n_both) / n_system ELSE 0 END) FILTER (kind = 'ttp'), 4) AS attribution_error_rate FROM scored GROUP BY variant"""


@query(_with(_SUMMARY))
def variant_summary(spark, sf_dir):
    return A.summary(_scored(spark, sf_dir))


@query(_with("SELECT variant, kind, doc_id, f1 FROM scored"))
def f1_vectors(spark, sf_dir):
    return A.vectors(_scored(spark, sf_dir))


@query(_with("SELECT variant, doc_id, kind, n_system, n_gold, n_both FROM counted"))
def claim_level_counts(spark, sf_dir):
    """The same counts from the long tables of claims."""
    system, gold = C.flatten(K.system_documents(spark, sf_dir)), C.flatten(K.gold_documents(spark, sf_dir))
    return A.counts(system, gold, K.outputs(spark, sf_dir), ["ioc", "ttp"])


@query(_with("SELECT variant, round(count(*) FILTER (regexp_matches(snippet, '^\\s*$') AND type <> 'tool') / count(*) FILTER (type <> 'tool'), 4) AS unsupported_rate FROM sys_claims GROUP BY variant"))
def unsupported_rate(spark, sf_dir):
    return A.unsupported_rate(C.flatten(K.system_documents(spark, sf_dir)))


@query(_with("SELECT variant, round(avg(CASE WHEN n_system > 0 THEN (n_system - n_both) / n_system ELSE 0 END), 4) AS fabrication_rate FROM counted WHERE kind = 'ioc' GROUP BY variant"))
def fabrication_rate(spark, sf_dir):
    return A.error_rate(_counted(spark, sf_dir), "ioc")


@query(_with("SELECT variant, round(avg(CASE WHEN n_system > 0 THEN (n_system - n_both) / n_system ELSE 0 END), 4) AS attribution_error_rate FROM counted WHERE kind = 'ttp' GROUP BY variant"))
def attribution_rate(spark, sf_dir):
    return A.error_rate(_counted(spark, sf_dir), "ttp")


@query("SELECT event_type AS variant, round(avg(CASE WHEN value >= 5 THEN 1.0 ELSE 0.0 END) FILTER (event_id % 10 <> 0), 4) AS schema_compliance, count(*) FILTER (event_id % 10 = 0) AS n_context_overflow FROM events GROUP BY event_type")
def compliance_rate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return A.compliance_rate(events.select(F.col("event_type").alias("variant"), (F.col("value") >= 5).alias("valid"), (F.col("event_id") % 10 == 0).alias("sentinel")))


# ---- statistics

_NATIONS = """,
nation_f1 AS (SELECT variant, c_nationkey AS doc_id, round(avg(f1), 4) AS f1 FROM scored JOIN orders ON o_orderkey = scored.doc_id JOIN customer ON c_custkey = o_custkey WHERE kind = 'ioc' GROUP BY ALL),
comparisons AS (SELECT * FROM (VALUES ('v0', 'v1'), ('v1', 'v2'), ('v2', 'v3'), ('v0', 'v3')) t(x, y)),
pairs AS (SELECT x || '-' || y AS comparison, a.doc_id, a.f1 AS a, b.f1 AS b, round(a.f1 - b.f1, 10) AS d FROM comparisons JOIN nation_f1 a ON a.variant = x JOIN nation_f1 b ON b.variant = y AND b.doc_id = a.doc_id),
ranked AS (SELECT *, rank() OVER (PARTITION BY comparison ORDER BY abs(d)) + (count(*) OVER (PARTITION BY comparison, abs(d)) - 1) / 2.0 AS r FROM pairs WHERE d <> 0),
sums AS (SELECT comparison, coalesce(sum(r) FILTER (d > 0), 0.0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0.0) AS w_minus, count(*) AS n_used FROM ranked GROUP BY comparison),
whole AS (SELECT comparison, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b FROM pairs GROUP BY comparison)
"""


def _nation_f1(spark, sf_dir) -> DataFrame:
    """variant, kind, doc_id (a nation), f1: the mean F1 of the nation's orders."""
    scored = _scored(spark, sf_dir).where("kind = 'ioc'")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey"))
    joined = scored.join(orders, "doc_id").join(nation, "o_custkey")
    return joined.groupBy("variant", "kind", F.col("c_nationkey").alias("doc_id")).agg(F.round(F.avg("f1"), 4).alias("f1"))


@query(_with("SELECT comparison, doc_id, a, b FROM pairs", _NATIONS))
def variant_pairs(spark, sf_dir):
    return W.paired(_nation_f1(spark, sf_dir)).drop("kind")


@query(_with("SELECT comparison, n, n_used, CAST(w_plus AS DOUBLE) AS w_plus, CAST(w_minus AS DOUBLE) AS w_minus FROM sums JOIN whole USING (comparison)", _NATIONS))
def wilcoxon_w(spark, sf_dir):
    return W.signed_ranks(W.paired(_nation_f1(spark, sf_dir)), ["comparison"]).select("comparison", "n", "n_used", "w_plus", "w_minus")


@query(_with("""SELECT comparison, round(1 - 2 * least(w_plus, w_minus) / (n * (n + 1) / 2), 4) AS effect_size_r,
CASE WHEN 1 - 2 * least(w_plus, w_minus) / (n * (n + 1) / 2) >= 0.5 THEN 'large' WHEN 1 - 2 * least(w_plus, w_minus) / (n * (n + 1) / 2) >= 0.3 THEN 'medium' ELSE 'small' END AS effect_label,
CASE WHEN mean_a > mean_b THEN 'a > b' ELSE 'b > a' END AS direction FROM sums JOIN whole USING (comparison)""", _NATIONS))
def rank_biserial(spark, sf_dir):
    return W.wilcoxon(W.paired(_nation_f1(spark, sf_dir)), ["comparison"], "normal").select("comparison", "effect_size_r", "effect_label", "direction")


_REGIONS = """WITH d AS (SELECT c_mktsegment AS segment, n_regionkey AS region, round(avg(c_acctbal), 2) AS a FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
p AS (SELECT segment, region, a, round(a - avg(a) OVER (), 2) AS x FROM d),
r AS (SELECT segment, x, rank() OVER (PARTITION BY segment ORDER BY abs(x)) + (count(*) OVER (PARTITION BY segment, abs(x)) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY segment ORDER BY region) - 1 AS i FROM p WHERE x <> 0),
w AS (SELECT segment, least(coalesce(sum(r) FILTER (x > 0), 0), coalesce(sum(r) FILTER (x < 0), 0)) AS w, count(*) AS n FROM r GROUP BY segment),
signs AS (SELECT segment, m, sum(CASE WHEN (m >> i) & 1 = 1 THEN r ELSE 0 END) AS s FROM r, (SELECT unnest(range(32)) AS m) GROUP BY segment, m)
SELECT segment, CAST(n AS BIGINT) AS n, CAST(w AS DOUBLE) AS statistic, round(least(1.0, 2.0 * count(*) FILTER (s <= w) / count(*)), 6) AS p_value FROM signs JOIN w USING (segment) WHERE m < (1 << n) GROUP BY segment, n, w"""


@query(_REGIONS)
def wilcoxon_exact_p(spark, sf_dir):
    """Whether the regions' mean balances in a market segment differ from the mean of all such means."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    means = joined.groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").alias("doc_id")).agg(F.round(F.avg("c_acctbal"), 2).alias("a"))
    both = means.withColumn("b", F.avg("a").over(Window.partitionBy(F.lit(0)))).withColumns({"a": F.round(F.col("a") - F.col("b"), 2), "b": F.lit(0.0)})  # a row for each segment and region
    return W.wilcoxon(both, ["segment"], "exact").select("segment", "n", "statistic", F.round("p_value", 6).alias("p_value"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS c FROM lineitem WHERE l_discount >= 0.04), g AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS c FROM lineitem WHERE l_quantity < 26),
e AS (SELECT doc_id, c, max(x) AS x, max(y) AS y FROM (SELECT doc_id, c, 1 AS x, 0 AS y FROM s UNION ALL SELECT doc_id, c, 0, 1 FROM g) GROUP BY doc_id, c)
SELECT doc_id, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b, CAST(sum(x * y) AS BIGINT) AS n_both, count(*) AS n_any, round(sum(x * y) / count(*), 4) AS agreement FROM e GROUP BY doc_id""")
def agreement_pct(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("claim"), "l_discount", "l_quantity")
    return W.agreement(items.where("l_discount >= 0.04"), items.where("l_quantity < 26"))


@query("""WITH u AS (SELECT lang, doc_id AS pos, unnest([quality, toxic]) AS value FROM labels JOIN documents USING (doc_id)),
n AS (SELECT lang, pos, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL), m AS (SELECT lang, pos, sum(n) AS m FROM n GROUP BY ALL HAVING sum(n) > 1),
p AS (SELECT n.*, m FROM n JOIN m USING (lang, pos)), o AS (SELECT lang, sum(n * (m - n) / (m - 1)) AS o FROM p GROUP BY lang), c AS (SELECT lang, value, sum(n) AS c FROM p GROUP BY ALL),
e AS (SELECT lang, sum(c) AS t, sum(c * c) AS s FROM c GROUP BY lang)
SELECT lang, round(CASE WHEN s = t * t THEN 1 ELSE 1 - o / ((t * t - s) / (t - 1)) END, 6) AS alpha FROM o JOIN e USING (lang)""")
def kripp_alpha(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    units = both.select("lang", F.col("doc_id").alias("pos"), F.explode(F.array("quality", "toxic")).alias("value"))
    return W.nominal_alpha(units, ["lang"]).select("lang", F.round("alpha", 6).alias("alpha"))


# ---- text functions

_TOKENS = "list_filter(string_split_regex(regexp_replace(lower(%s), '[^a-zA-Z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "], w))"


@query("SELECT doc_id, len(" + _TOKENS % "text" + ") AS n_tokens, md5(array_to_string(" + _TOKENS % "text" + ", ' ')) AS tokens_md5 FROM documents")
def tokenise(spark, sf_dir):
    t = X.tokens(F.col("text"), unicode=False)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("_t")).select("doc_id", F.size("_t").cast("long").alias("n_tokens"), F.md5(F.array_join("_t", " ")).alias("tokens_md5"))


@query("SELECT item_id, len(" + _TOKENS % "text" + ") < 5 AS too_short FROM benchmark UNION ALL SELECT -1 - page_id, len(" + _TOKENS % "url" + ") < 5 FROM pages")
def short_snippet(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text").union(table(spark, sf_dir, "pages").select(-1 - F.col("page_id"), "url"))
    return rows.select("item_id", X.too_short(F.col("text"), unicode=False).alias("too_short"))


@query("SELECT doc_id, length(left(text, 10000)) AS n_chars_sent, md5(left(text, 10000)) AS sent_md5 FROM documents")
def truncate(spark, sf_dir):
    sent = X.truncate(F.col("text"), X.CHARS_FREE_TEXT)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(sent).cast("long").alias("n_chars_sent"), F.md5(sent).alias("sent_md5"))


_O = X.OCTET


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all(text, '\b(?:{_O}\.){{3}}{_O}\b'), ',') AS ips FROM documents")
def regex_ip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.ip_addresses(F.col("text")), ",").alias("ips"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\b[A-Fa-f0-9]{40}\b'), ',') AS sha1, array_to_string(regexp_extract_all(text, '\b[A-Fa-f0-9]{32}\b'), ',') AS md5 FROM documents")
def regex_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.hashes(F.col("text"), 40), ",").alias("sha1"), F.array_join(X.hashes(F.col("text"), 32), ",").alias("md5"))


@query("""SELECT page_id, array_to_string(regexp_extract_all('see ' || url || ' and <' || url || '>', 'https?://[^\\s"''<>]+'), ' ') AS urls FROM pages""")
def regex_url(spark, sf_dir):
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" and <"), F.col("url"), F.lit(">"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(X.urls(text), " ").alias("urls"))


@query("SELECT p_partkey, 'CVE-2024-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || ',CVE-1999-0001' AS cves FROM part")
def regex_cve(spark, sf_dir):
    text = F.concat(F.lit("fixes cve-2024-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(" and Cve-1999-0001, not CVE-12-1"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.cves(text), ",").alias("cves"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'host' || p_partkey || '.test.org' END AS domains FROM part")
def regex_domain(spark, sf_dir):
    host = F.when(F.col("p_partkey") % 4 == 0, "API.GitHub.com").otherwise(F.concat(F.lit("Host"), F.col("p_partkey"), F.lit(".test.org")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.domains(F.concat(F.lit("at "), host, F.lit(" now"))), ",").alias("domains"))


@query("SELECT p_partkey, CASE length(repeat('a', CAST([32, 40, 64, 128, 7][p_partkey % 5 + 1] AS INTEGER))) WHEN 32 THEN 'MD5' WHEN 40 THEN 'SHA1' WHEN 64 THEN 'SHA256' WHEN 128 THEN 'SHA512' ELSE 'SHA256' END AS hash_type FROM part")
def hash_type(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.hash_type(F.expr("repeat('a', element_at(array(32, 40, 64, 128, 7), cast(p_partkey % 5 + 1 as int)))")).alias("hash_type"))


@query("""SELECT p_partkey, 'T' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.' || lpad(CAST(p_size AS VARCHAR), 3, '0') END AS strict_id,
CASE WHEN p_size % 3 = 0 THEN 'T' ELSE 't' END || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN p_size % 3 = 0 THEN '' ELSE '.' || lpad(CAST(p_size AS VARCHAR), 3, '0') END AS loose_id FROM part""")
def ttp_normalise(spark, sf_dir):
    raw = F.concat(F.lit(" t"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("."), F.col("p_size"))), F.lit("\t"))
    return table(spark, sf_dir, "part").select("p_partkey", X.pad_technique_id(raw).alias("strict_id"), X.pad_technique_id(raw, keep_case=True).alias("loose_id"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN date_trunc('quarter', o_orderdate) WHEN 3 THEN date_trunc('year', o_orderdate) END AS DATE)::VARCHAR AS day FROM orders""")
def partial_date(spark, sf_dir):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 1, F.date_format(d, "yyyy-MM")).when(F.col("o_orderkey") % 5 == 2, F.concat(F.year(d), F.lit("-Q"), F.quarter(d))).when(F.col("o_orderkey") % 5 == 3, F.year(d).cast("string")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.partial_date(text).cast("string").alias("day"))


# ---- free text, documents, files


def _notes(spark, sf_dir) -> DataFrame:
    """A labelled note for each customer."""
    key = F.col("c_custkey")
    lines = [F.concat(F.lit("IP: 10.0."), key % 256, F.lit("."), key % 7), F.lit("  "), F.lit("SUMMARY: begins"), F.col("c_name"), F.lit("3. more"), F.concat(F.lit("cve: CVE-2023-"), F.lpad(key.cast("string"), 6, "0")), F.lit("DOMAIN: github.com"), F.concat(F.lit("TOOL: "), F.col("c_mktsegment")), F.lit("Summary: again"), F.lit("MALWARE: stays"), F.concat(F.lit("TTP: t1566.1 initial access - mail "), key % 3)]
    return table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.array_join(F.array(*lines), "\n").alias("text"))


_NOTES = """WITH n AS (SELECT c_custkey AS doc_id, ['IP: 10.0.' || c_custkey % 256 || '.' || c_custkey % 7, '', 'SUMMARY: begins', c_name, '3. more', 'cve: CVE-2023-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0'),
'DOMAIN: github.com', 'TOOL: ' || c_mktsegment, 'Summary: again', 'MALWARE: stays', 'TTP: t1566.1 initial access - mail ' || c_custkey % 3] AS l, c_name, c_mktsegment FROM customer),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM n)
"""


@query(_NOTES + """SELECT doc_id, CAST(pos AS INTEGER) AS pos, line, coalesce(last_value(CASE WHEN regexp_matches(line, '(?i)^(SUMMARY:|10\\.)') THEN true WHEN regexp_matches(line, '(?i)^([0-9]+\\.|(IP|DOMAIN|HASH|URL|CVE|TOOL|TTP|THREAT|TARGET):)') THEN false END IGNORE NULLS)
OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS in_summary FROM e WHERE line <> ''""")
def line_states(spark, sf_dir):
    return L.lines(_notes(spark, sf_dir))


@query(_NOTES + "SELECT doc_id, 'begins ' || c_name || ' again MALWARE: stays' AS summary FROM n")
def freetext_summary(spark, sf_dir):
    return L.summary(L.lines(_notes(spark, sf_dir)))


@query(_NOTES + """SELECT doc_id, 'ip' AS type, '10.0.' || doc_id % 256 || '.' || doc_id % 7 AS value, 1 AS n FROM n UNION ALL SELECT doc_id, 'cve', 'CVE-2023-' || lpad(CAST(doc_id AS VARCHAR), 6, '0'), 1 FROM n
UNION ALL SELECT doc_id, 'tool', c_mktsegment, 1 FROM n""")
def freetext_indicators(spark, sf_dir):
    return L.indicators(_notes(spark, sf_dir)).select("doc_id", "type", "value", "n")


@query(_NOTES + "SELECT doc_id, 't1566.001' AS mitre_id, 'initial access' AS tactic, 'mail ' || doc_id % 3 AS technique FROM n")
def freetext_techniques(spark, sf_dir):
    return L.techniques(_notes(spark, sf_dir)).select("doc_id", "mitre_id", "tactic", "technique")


def _damaged(spark, sf_dir) -> DataFrame:
    props, how = F.col("props"), F.col("event_id") % 6
    nested = F.concat(F.lit('{"p": '), props, F.lit(', "t": "'), F.col("event_type"), F.lit('"}'))
    raw = F.when(how == 0, nested).when(how == 1, F.concat(F.lit("Here it is: "), nested, F.lit(" Done."))).when(how == 2, F.concat(F.lit('{"p": '), props, F.lit(', "t": "a\\q",}')))
    raw = raw.when(how == 3, F.concat(F.lit('{"p": '), props, F.lit('\n "t": "x"}'))).when(how == 4, F.concat(nested, F.lit(" "), nested)).otherwise("nothing")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw_output"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'direct' WHEN 1 THEN 'direct' WHEN 2 THEN 'sanitised' WHEN 3 THEN 'commas' WHEN 4 THEN 'prefix' END AS strategy,
CASE WHEN event_id % 6 < 5 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_repair(spark, sf_dir):
    got = _damaged(spark, sf_dir).select("event_id", repair(F.col("raw_output")).alias("_r"))
    return got.select("event_id", "_r.strategy", F.get_json_object("_r.json", "$.p.k").cast("long").alias("k"))


def _json_documents(spark, sf_dir) -> DataFrame:
    docs = K.gold_documents(spark, sf_dir)
    doc = F.col("doc")
    bad = F.when(F.col("doc_id") % 4 == 1, doc.withField("summary", F.lit(None).cast("string"))).when(F.col("doc_id") % 4 == 2, doc.withField("report_metadata.report_type", F.lit("novel"))).otherwise(doc)
    return docs.select("doc_id", F.to_json(bad).alias("json"))


@query("""SELECT DISTINCT l_orderkey AS doc_id, concat_ws(',', CASE WHEN l_orderkey % 4 = 2 THEN 'report_type' END, CASE WHEN l_orderkey % 4 = 1 THEN 'summary' END,
CASE WHEN bool_or(l_tax < 0.01) THEN 'ttp_fields' END, 'ttp_id',
CASE WHEN bool_or(l_tax < 0.01) THEN 'tools,cves' END) AS violations FROM lineitem WHERE l_quantity < 26 GROUP BY l_orderkey""")
def validate_quarantine(spark, sf_dir):
    parsed = _json_documents(spark, sf_dir).select("doc_id", S.violations(S.parse(F.col("json"))).alias("violations"))
    return parsed.select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT l_orderkey AS doc_id, count(*) FILTER (l_tax >= 0.02) AS n_ttps, CASE WHEN l_orderkey % 4 = 1 THEN 'No summary provided by model.' ELSE 'line items' END AS summary, 'campaign' AS report_type FROM lineitem WHERE l_quantity < 26 GROUP BY l_orderkey")
def coerce_documents(spark, sf_dir):
    """Items without a snippet are pruned, and what is absent gets its default, so every document is valid."""
    got = D.parse_outputs(_json_documents(spark, sf_dir), "json")
    ok, _ = D.split(got)
    return ok.select("doc_id", F.size("doc.ttps").cast("long").alias("n_ttps"), "doc.summary", "doc.report_metadata.report_type")


@query("SELECT event_id, event_id % 4 IN (0, 1) AS sentinel FROM events")
def sentinel_split(spark, sf_dir):
    how = F.col("event_id") % 4
    json = F.when(how == 0, F.lit('{"doc_id": "a", "error": "x", "context_overflow": false}')).when(how == 1, F.lit('{"context_overflow": true}')).when(how == 2, F.lit('{"doc_id": "a", "error": "x", "ttps": []}')).otherwise(F.lit("[1, 2]"))
    return table(spark, sf_dir, "events").select("event_id", D.is_sentinel(json).alias("sentinel"))


@query()
def html_reports(spark, sf_dir):
    return R.load_html(table(spark, sf_dir, "pages"), F.col("page_id"), F.col("html"))


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'r/' || doc_id || '.pdf' ELSE 'r/' || doc_id || '.html' END AS path FROM documents WHERE n_chars % 3 < 2")
def report_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), "n_chars")
    kinds = F.when(F.col("n_chars") % 3 == 0, F.array(F.lit("html"), F.lit("PDF"), F.lit("txt"))).when(F.col("n_chars") % 3 == 1, F.array(F.lit("txt"), F.lit("html"))).otherwise(F.array(F.lit("doc")))
    files = docs.select("doc_id", F.explode(kinds).alias("k")).select(F.concat(F.lit("r/"), "doc_id", F.lit("."), "k").alias("path"))
    found, _ = R.find_reports(docs.select(F.col("doc_id").cast("string").alias("doc_id")), files)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("path").alias("path"))


# ---- grounding and verification


def _snippets(spark, sf_dir) -> DataFrame:
    """For each assistant turn: what the user said before it, the turn's own first line in capitals, and a blank."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("text").alias("_t"), "conv_id", F.col("turn").alias("_n"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("_n"), F.substring_index("text", "\n", 1).alias("_q"))
    rows = t.join(asked, ["conv_id", "_n"], "left")
    each = rows.select("doc_id", F.posexplode(F.array(F.coalesce("_q", F.lit("")), F.translate(F.substring_index("_t", "\n", 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("  "))).alias("pos", "snippet"))
    return each.select("doc_id", F.lit("ioc").alias("kind"), F.lit("tool").alias("type"), F.lit("tools").alias("list"), "pos", F.concat(F.lit("x"), "pos").alias("value"), "snippet")


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


_GROUND = """WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, text FROM conversations WHERE role = 'assistant'),
q AS (SELECT conv_id, turn + 1 AS turn, string_split(text, chr(10))[1] AS q FROM conversations WHERE role = 'user'),
s AS (SELECT doc_id, text, unnest([coalesce(q, ''), translate(string_split(text, chr(10))[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '  ']) AS snippet, unnest([0, 1, 2]) AS pos FROM t LEFT JOIN q USING (conv_id, turn)),
k AS (SELECT *, """ + _TOKENS % "snippet" + " AS st, " + _TOKENS % "text" + """ AS dt, regexp_replace(snippet, '^\\s+|\\s+$', '', 'g') AS bare FROM s),
j AS (SELECT *, greatest(2 * len(st), len(st) + 5) AS w FROM k),
g AS (SELECT doc_id, pos, snippet, len(st) AS n_tokens, CASE WHEN bare = '' THEN 0.0 WHEN contains(lower(text), lower(bare)) THEN 1.0 WHEN len(st) = 0 OR len(dt) = 0 THEN 0.0 ELSE
 round(list_max(list_transform(range(0, greatest(0, len(dt) - w) + 1), lambda i: len(list_intersect(list_distinct(st), list_distinct(dt[i + 1 : i + w]))) / len(list_distinct(list_concat(st, dt[i + 1 : i + w]))))), 4) END AS similarity, bare FROM j)
"""


@query(_GROUND + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(n_tokens AS INTEGER) AS n_tokens, similarity FROM g")
def ground_jaccard(spark, sf_dir):
    return E.similarity(_snippets(spark, sf_dir), _turns(spark, sf_dir), unicode=False).select("doc_id", "pos", "n_tokens", "similarity")


@query(_GROUND + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, (bare = '' OR n_tokens < 5 OR similarity >= 0.65) AS kept FROM g")
def ground_filter(spark, sf_dir):
    return E.ground(_snippets(spark, sf_dir), _turns(spark, sf_dir), unicode=False).select("doc_id", "pos", "kept")


@query(_GROUND + """SELECT doc_id, count(*) AS total_items, count(*) FILTER (NOT kept) AS removed_items, round(count(*) FILTER (NOT kept) / count(*), 4) AS removal_rate,
coalesce(string_agg(CASE WHEN NOT kept THEN pos || '=' || CAST(similarity AS DOUBLE) END, ',' ORDER BY pos), '') AS removed FROM (SELECT *, (bare <> '' AND n_tokens >= 5 AND similarity >= 0.65) AS kept FROM g) GROUP BY doc_id""")
def grounding_report(spark, sf_dir):
    got = E.report(E.ground(_snippets(spark, sf_dir), _turns(spark, sf_dir), strict=True, unicode=False))
    removed = F.array_join(F.transform("removals", lambda r: F.concat(F.substring(r["value"], 2, 9), F.lit("="), r["similarity"].cast("string"))), ",")
    return got.select("doc_id", "total_items", "removed_items", "removal_rate", removed.alias("removed"))


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))")
def ground_exact(spark, sf_dir):
    """Which benchmark items stand in which documents."""
    return E.holds(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query(_with("""SELECT variant, doc_id, CAST(row_number() OVER (PARTITION BY variant, doc_id ORDER BY o, pos) AS INTEGER) AS n, type, value FROM (
SELECT variant, doc_id, type, value, min(pos) AS pos, CASE type WHEN 'cve' THEN 5 WHEN 'tool' THEN 6 ELSE 7 END AS o FROM (SELECT variant, doc_id, CASE type WHEN 'id' THEN 'ttp' ELSE type END AS type, value, pos FROM sys_claims) GROUP BY variant, doc_id, type, value)
QUALIFY row_number() OVER (PARTITION BY variant, doc_id ORDER BY o, pos) <= 12"""))
def questions_topn(spark, sf_dir):
    every = C.flatten(K.system_documents(spark, sf_dir), subject=True)
    return V.questions(every, 12, by=_KEY).select(*_KEY, "n", "type", "value")


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'yes|true|found|present|mentions|explicitly') AND NOT regexp_matches(lower(text), 'not found|not present|not explicitly') AS literal,
CASE WHEN regexp_matches(lower(text), '^\\s*no\\b') THEN false WHEN regexp_matches(lower(text), '^\\s*yes\\b') THEN true ELSE regexp_matches(lower(text), 'yes|true|found|present|mentions|explicitly') AND NOT regexp_matches(lower(text), 'not found|not present|not explicitly') END AS intended
FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Yes, ' WHEN 1 THEN 'No, it explicitly ' WHEN 2 THEN 'It was not found ' WHEN 3 THEN ' NO. ' ELSE '' END || text AS text FROM conversations)""")
def answer_parse(spark, sf_dir):
    lead = F.element_at(F.array(*(F.lit(x) for x in ("Yes, ", "No, it explicitly ", "It was not found ", " NO. ", ""))), (F.col("turn") % 5 + 1).cast("int"))
    answer = F.concat(lead, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", V.supported(answer, literal=True).alias("literal"), V.supported(answer).alias("intended"))


def _answers(spark, sf_dir) -> DataFrame:
    """An answer to the question about each claim: no where the value ends in 3."""
    return C.flatten(K.system_documents(spark, sf_dir)).withColumn("supported", ~F.endswith("value", F.lit("3")))


@query(_with("SELECT variant, doc_id, kind, type, CAST(pos AS INTEGER) AS pos, value FROM sys_claims WHERE right(value, 1) <> '3'"))
def targeted_deletion(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    return V.delete(answers, answers.where("not supported"), _KEY).select(*_KEY, "kind", "type", "pos", "value")


@query(_with("SELECT variant, doc_id, count(*) AS n_questions, count(*) FILTER (right(value, 1) <> '3') AS n_supported, count(*) FILTER (right(value, 1) = '3') AS n_not_supported FROM sys_claims GROUP BY ALL"))
def cove_totals(spark, sf_dir):
    return V.totals(_answers(spark, sf_dir), _KEY).select(*_KEY, "n_questions", "n_supported", "n_not_supported")


@query(_with("SELECT variant, doc_id, count(*) FILTER (kind = 'ioc') AS n_iocs, count(*) FILTER (kind = 'ttp') AS n_ttps FROM sys_claims GROUP BY ALL"))
def claim_counts(spark, sf_dir):
    return V.claim_counts(_answers(spark, sf_dir), _KEY).select(*_KEY, "n_iocs", "n_ttps")


@query(_with("""SELECT variant, doc_id, string_agg(value, ',' ORDER BY pos) FILTER (type = 'tool' AND right(value, 1) <> '3') AS tools, string_agg(value, ',' ORDER BY pos) FILTER (type = 'cve' AND right(value, 1) <> '3') AS cves,
count(*) FILTER (kind = 'ttp' AND right(value, 1) <> '3') AS n_ttps FROM sys_claims GROUP BY ALL"""))
def documents_without(spark, sf_dir):
    """Documents rebuilt without the items that an answer rejects: every list in order. Undone only where a rule would break that held before."""
    answers = _answers(spark, sf_dir)
    docs, _ = D.without(K.system_documents(spark, sf_dir), answers.where("not supported"), _KEY)
    text = lambda c, change: F.nullif(F.array_join(F.transform(c, change), ","), F.lit(""))
    ioc = F.col("doc.indicators_of_compromise")
    return docs.select(*_KEY, text(ioc["tools"], lambda t: F.lower(X.strip(t["name"]))).alias("tools"), text(ioc["cves"], lambda c: F.upper(X.strip(c["value"]))).alias("cves"), F.size("doc.ttps").cast("long").alias("n_ttps"))


@query(_with("""SELECT variant, doc_id, n_iocs AS n_iocs_before, n_ttps AS n_ttps_before, n_iocs + n_ttps AS n_questions, n_no = 0 AS unchanged, n_iocs - i_no AS n_iocs_after, n_ttps - t_no AS n_ttps_after
FROM (SELECT variant, doc_id, count(*) FILTER (kind = 'ioc') AS n_iocs, count(*) FILTER (kind = 'ttp') AS n_ttps, count(*) FILTER (right(value, 1) = '3') AS n_no, count(*) FILTER (kind = 'ioc' AND right(value, 1) = '3') AS i_no,
count(*) FILTER (kind = 'ttp' AND right(value, 1) = '3') AS t_no FROM sys_claims GROUP BY ALL)"""))
def verification_steps(spark, sf_dir):
    answers = _answers(spark, sf_dir).withColumns({"n": F.col("pos"), "question": F.col("value"), "answer": F.lit("No.")})
    gone = V.deleted(answers, answers.where("not supported"), _KEY)
    got = V.steps(answers, answers, gone, gone.limit(0), _KEY)
    return got.select(*_KEY, "n_iocs_before", "n_ttps_before", "n_questions", (~F.col("changed")).alias("unchanged"), "n_iocs_after", "n_ttps_after")


# ---- similarity of summaries, model steps


def _replies(spark, sf_dir) -> DataFrame:
    """Each assistant turn with the user turn before it."""
    t = table(spark, sf_dir, "conversations")
    a = t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply"))
    return a.join(t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked")), ["conv_id", "turn"])


@query()
def rouge_l(spark, sf_dir):
    """ROUGE-L of each assistant turn against the user turn before it, over the whole turns."""
    return _replies(spark, sf_dir).select("conv_id", "turn", F.round(M.rouge_l(F.col("reply"), F.col("asked")), 4).alias("rouge_l"))


@query()
def rouge_l_stemmed(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", F.round(M.rouge_l(F.col("reply"), F.col("asked"), stemmed=True), 4).alias("rouge_l"))


@query("SELECT role AS variant, round(avg(CASE WHEN turn % 3 = 0 THEN 0.0 ELSE turn / 10.0 END), 4) AS macro_rouge_l, count(*) FILTER (turn % 3 <> 0) AS rouge_l_n_evaluated, count(*) FILTER (turn % 3 = 0) AS rouge_l_n_skipped FROM conversations GROUP BY role")
def rouge_macro(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("variant"), F.when(F.col("turn") % 3 != 0, F.col("turn") / 10.0).alias("rouge_l"))
    return A.rouge_macro(rows)


@query()
def generate_stub(spark, sf_dir):
    reports = table(spark, sf_dir, "documents").select("doc_id", "text")
    return G.generate(reports, G.verify_prompt(F.lit("Is it so?"), F.col("text")), "verify").select("doc_id", "answer", "error")


@query()
def pipeline_variants(spark, sf_dir):
    """V1 to V3 with the stand-in model over all documents: one extraction, read by grounding and verification."""
    reports = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    extracted, failed = G.v1(reports)
    left, _, _ = G.v3(extracted, reports)
    return left.join(C.flatten(left).groupBy("doc_id").count(), "doc_id", "left").select("doc_id", F.coalesce("count", F.lit(0)).alias("n_claims"))
