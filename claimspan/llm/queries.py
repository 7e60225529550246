"""The queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontaminate as op1
from . import jaccard_join as op6
from . import language_id as op4
from . import line_dedup as op2
from . import media as op9
from . import mixing as op5
from . import quality as op8
from . import substring_dedup as op10
from . import toxicity as op3
from . import warc as op7
from .common import table

#: The words of a text, in DuckDB.
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = op2.line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("_row.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op3.toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"), threshold=0.7)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.language_id(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = op5.mix_sources(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, and what the audit says of a replica in which rot and loss are planted by the digest of the html:
    of one record in 256 the last byte is another, and another one in 256 is gone; rows of one id share a fate."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    fate = F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 2)
    planted = F.when(fate.isin("00", "01"), fate)
    # Records of one id lie in one segment, so their fate is a window of the same exchange and moves no record again; those without an id lie in several.
    none = pages.where(F.col("page_id").cast("long").isNull()).agg(F.min(planted)).first()[0]
    laid = op7.records(pages.withColumn("_fate", planted), keep=("_fate",))
    own = F.when(F.col("page_id").isNull(), F.lit(none).cast("string")).otherwise(F.min("_fate").over(Window.partitionBy("segment", "page_id")))
    stored = op7.store(laid.withColumn("_fate", F.coalesce(own, F.lit(""))), "primary")
    primary = stored.drop("_fate")
    rotten = F.concat(F.substring("record", F.lit(1), F.octet_length("record") - 1), F.lit("X").cast("binary"))
    rows = stored.where(F.col("_fate") != "01").withColumn("record", F.when(F.col("_fate") == "00", rotten).otherwise(F.col("record")))
    replica = op7.store(rows.select(*primary.columns), "replica")
    leaves, differences = op7.fixity(primary, replica)
    rows = primary.select("page_id", "segment", "seq", "offset", "length")
    found = differences.select("segment", "seq", "status")
    return (
        rows.join(leaves.select("segment", F.col("ix").alias("seq"), "record_sha256"), ["segment", "seq"])
        .join(found, ["segment", "seq"], "left")
        .select("page_id", "segment", "seq", "offset", "length", "record_sha256", F.coalesce("status", F.lit("ok")).alias("status"))
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.5)


def op9_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.audio_features(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_line_dedup, op3_toxicity, op4_language_id, op5_mix_sources, op6_jaccard_components, op7_warc_fixity, op8_quality, op9_media_features, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": r"""
WITH l AS (SELECT doc_id, i, lines[i] AS line, translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, unnest(range(1, len(lines) + 1)) AS i FROM documents)),
hot AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.k = hot.k GROUP BY doc_id""",
        "op6_jaccard_components": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS t
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.y) AS component_id
FROM reach JOIN w ON w.doc_id = reach.x LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
        "op7_warc_fixity": r"""
WITH b AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
                  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: '
                  || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS block FROM pages),
r AS (SELECT page_id, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
             || 'WARC-Record-ID: <urn:sha256:' || sha256(block) || '>' || chr(13) || chr(10) || 'Content-Type: application/http;msgtype=response' || chr(13) || chr(10)
             || 'Content-Length: ' || octet_length(encode(block)) || chr(13) || chr(10) || chr(13) || chr(10) || block || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM b),
l AS (SELECT page_id, html, record, page_id // 1024 AS segment, CAST(octet_length(encode(record)) AS BIGINT) AS length FROM r)
SELECT page_id, segment, row_number() OVER o - 1 AS seq, CAST(sum(length) OVER o - length AS BIGINT) AS offset, length, sha256(record) AS record_sha256,
       CASE substr(sha256(html), 1, 2) WHEN '00' THEN 'corrupt' WHEN '01' THEN 'missing' ELSE 'ok' END AS status
FROM l WINDOW o AS (PARTITION BY segment ORDER BY page_id ROWS UNBOUNDED PRECEDING)""",
        "op10_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS words FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 12], ' ')) AS phrase
           FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
first AS (SELECT phrase, min(doc_id) AS least FROM starts GROUP BY phrase),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM starts JOIN first USING (phrase) WHERE least < doc_id),
each AS (SELECT w.doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w) w),
left_over AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.p) AS kept, count(*) AS n
              FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.p = gone.p GROUP BY each.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)""",
    }
