"""Documents: pruning, coercion, normalisation, validation and quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.jsonrepair import last_resort, local_repair
from ..plans import schema as S
from .claims import with_document

# Fixed value: what a missing summary becomes.
NO_SUMMARY = "No summary provided by model."
# What in an error says that the model's context ran over.
OVERFLOW = ("json repair failed after four strategies", "context window", "context overflow", "max_tokens")


def _list(items: Column, empty: Column, keep, change=lambda x: x) -> Column:
    """The items to keep, changed; an absent list is empty."""
    return F.coalesce(F.transform(F.filter(items, lambda x: x.isNotNull() & keep(x)), change), empty)


def _empty(path: str) -> Column:
    kind = S.DOCUMENT
    for name in path.split("."):
        kind = kind[name].dataType
    return F.array().cast(kind)


def _full(*fields: Column) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & ~X.is_blank(f)
    return out


def _usable(kind: str, field: str):
    """Whether an indicator has its value and snippet, and a hash a known type."""
    if kind == "hash":
        return lambda i: _full(i[field], i["evidence_snippet"]) & F.coalesce(F.upper(X.strip(i["hash_type"])).isin(*X.HASH_TYPES), F.lit(False))
    return lambda i: _full(i[field], i["evidence_snippet"])


def _stored(kind: str, field: str):
    """An indicator as it is stored."""
    if kind == "hash":
        return lambda i: i.withField(field, X.stored_value(F.lit(kind), i[field])).withField("hash_type", F.upper(X.strip(i["hash_type"])))
    return lambda i: i.withField(field, X.stored_value(F.lit(kind), i[field]))


def coerce(doc: Column) -> Column:
    """_coerced, with the document bound once: its many uses would each parse it again."""
    return F.get(F.transform(F.array(doc), _coerced), 0)


def _coerced(doc: Column) -> Column:
    """A parsed document with unusable items pruned, ids and types normalised, and defaults for what is absent.

    A bad technique id becomes null and its item stays. Other enumerations are left to validation."""
    ioc = doc["indicators_of_compromise"]
    lists = {name: _list(ioc[name], _empty(f"indicators_of_compromise.{name}"), _usable(kind, field), _stored(kind, field)) for name, (kind, field) in S.INDICATORS.items()}
    rules = {n: _list(ioc["detection_signatures"][n], _empty(f"indicators_of_compromise.detection_signatures.{n}"), lambda i: _full(i["name"], i["evidence_snippet"])) for n in ("yara_rules", "sigma_rules")}
    padded = lambda t: X.pad_technique_id(t["mitre_id"])
    ttps = _list(doc["ttps"], _empty("ttps"), lambda t: _full(t["tactic"], t["technique"], t["evidence_snippet"]), lambda t: t.withField("mitre_id", F.when(padded(t).rlike(X.TECHNIQUE_ID), padded(t))))
    timeline = _list(doc["timeline"], _empty("timeline"), lambda t: _full(t["event"], t["evidence_snippet"]) & F.coalesce(X.strip(t["date"]).rlike(S.DATE), F.lit(False)))
    kind = doc["report_metadata"]["report_type"]
    meta = F.struct(F.when(kind.isin(*S.REPORT_TYPES), kind).otherwise("campaign").alias("report_type"), doc["report_metadata"]["report_title"].alias("report_title"))
    text = F.when(X.is_blank(doc["summary"]), NO_SUMMARY).otherwise(X.truncate(X.strip(doc["summary"]), X.CHARS_SUMMARY))
    actor = F.when(doc["threat_actor"].isNotNull(), doc["threat_actor"].withField("name", X.strip(doc["threat_actor"]["name"])).withField("aliases", F.coalesce(doc["threat_actor"]["aliases"], F.array().cast("array<string>"))))
    out = F.struct(
        meta.alias("report_metadata"), actor.alias("threat_actor"), X.strip(doc["campaign_name"]).alias("campaign_name"),
        _list(doc["target_sectors"], F.array().cast("array<string>"), lambda s: ~X.is_blank(s), lambda s: X.strip(s)).alias("target_sectors"),
        F.struct(*(c.alias(n) for n, c in lists.items()), F.struct(*(c.alias(n) for n, c in rules.items())).alias("detection_signatures")).alias("indicators_of_compromise"),
        ttps.alias("ttps"), text.alias("summary"), timeline.alias("timeline"),
    )
    return F.when(doc.isNotNull(), out.cast(S.DOCUMENT))


def parse_outputs(raw: DataFrame, column: str = "raw_output") -> DataFrame:
    """The columns of raw, then strategy, doc (coerced) and violations of each model output.

    Each is made once: only what no local stage repairs goes to Python, and rows come out of a generator, which no filter on them is pushed through."""
    fixed = raw.withColumn("_l", local_repair(F.col(column))).withColumn("_p", last_resort(F.when(F.col("_l").isNull(), F.col(column))))
    json, strategy = F.coalesce("_l.json", "_p"), F.coalesce("_l.strategy", F.when(F.col("_p").isNotNull(), "prefix"))
    row = F.transform(F.array(coerce(S.parse(json))), lambda d: F.struct(strategy.alias("strategy"), d.alias("doc"), S.violations(d).alias("violations")))
    return fixed.select(*raw.columns, F.inline(row))


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid documents, quarantine). One bad row never fails a stage."""
    ok = F.size("violations") == 0
    return parsed.where(ok), parsed.where(~ok)


def is_sentinel(json: Column) -> Column:
    """Whether a JSON text is an error sentinel: an object with a true context_overflow, or with error and doc_id and nothing of a document."""
    has = lambda k: F.coalesce(F.array_contains(F.json_object_keys(json), k), F.lit(False))
    truthy = F.get_json_object(json, "$.context_overflow")
    flag = F.coalesce(truthy.isNotNull() & ~truthy.isin("false", "0", "", "null", "[]", "{}"), F.lit(False))
    body = has("report_metadata") | has("indicators_of_compromise") | has("ttps")
    return F.coalesce(F.json_object_keys(json).isNotNull() & (flag | (has("error") & has("doc_id") & ~body)), F.lit(False))


def is_ancillary(stem: Column) -> Column:
    """Whether a file is a log or report that no evaluation reads."""
    return F.startswith(stem, F.lit("_")) | F.endswith(stem, F.lit("_cove_log"))


def is_overflow(message: Column) -> Column:
    return F.lower(message).rlike("|".join(OVERFLOW))


def sentinels(failed: DataFrame) -> DataFrame:
    """doc_id, error, context_overflow for failures (doc_id, error)."""
    return failed.select("doc_id", "error", F.coalesce(is_overflow(F.col("error")), F.lit(False)).alias("context_overflow"))


def from_freetext(found: DataFrame, techniques: DataFrame, summaries: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, doc: indicators, techniques and summaries of free text in the document's shape; snippets are empty, since free text has none."""
    item = F.struct(F.col("n"), F.col("value"), F.col("hash_type"))
    by_type = found.groupBy("doc_id").pivot("type", ["ip", "domain", "hash", "url", "cve", "tool"]).agg(F.array_sort(F.collect_list(item)))
    steps = techniques.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "mitre_id", "tactic", "technique"))).alias("_t"))
    rows = docs.select("doc_id").join(by_type, "doc_id", "left").join(steps, "doc_id", "left").join(summaries, "doc_id", "left")
    null, none = F.lit(None).cast("string"), F.lit("")
    of = lambda c, make, path: F.coalesce(F.transform(c, make), _empty(path))
    value = lambda x: F.struct(x["value"].alias("value"), none.alias("evidence_snippet"), null.alias("source_context"))
    ioc = F.struct(
        of("ip", value, "indicators_of_compromise.ip_addresses").alias("ip_addresses"),
        of("domain", lambda x: F.struct(x["value"].alias("value"), none.alias("evidence_snippet"), null.alias("source_context"), F.lit(False).alias("masked"), F.lit(False).alias("phishing_template")), "indicators_of_compromise.domains").alias("domains"),
        of("hash", lambda x: F.struct(x["value"].alias("value"), x["hash_type"].alias("hash_type"), none.alias("evidence_snippet"), null.alias("source_context")), "indicators_of_compromise.file_hashes").alias("file_hashes"),
        of("url", value, "indicators_of_compromise.urls").alias("urls"),
        _empty("indicators_of_compromise.http_paths").alias("http_paths"),
        of("tool", lambda x: F.struct(x["value"].alias("name"), none.alias("evidence_snippet")), "indicators_of_compromise.tools").alias("tools"),
        of("cve", value, "indicators_of_compromise.cves").alias("cves"),
        F.struct(_empty("indicators_of_compromise.detection_signatures.yara_rules").alias("yara_rules"), _empty("indicators_of_compromise.detection_signatures.sigma_rules").alias("sigma_rules")).alias("detection_signatures"),
    )
    ttps = of("_t", lambda t: F.struct(t["mitre_id"].alias("mitre_id"), t["tactic"].alias("tactic"), t["technique"].alias("technique"), none.alias("evidence_snippet"), F.lit("explicit").alias("mapping_type"), null.alias("mitre_confidence"), null.alias("evidence_location")), "ttps")
    doc = F.struct(
        F.struct(F.lit("campaign").alias("report_type"), null.alias("report_title")).alias("report_metadata"),
        F.lit(None).cast(S.DOCUMENT["threat_actor"].dataType).alias("threat_actor"), null.alias("campaign_name"), F.array().cast("array<string>").alias("target_sectors"),
        ioc.alias("indicators_of_compromise"), ttps.alias("ttps"), F.coalesce(X.truncate(F.col("summary"), X.CHARS_SUMMARY), F.lit("")).alias("summary"), _empty("timeline").alias("timeline"),
    )
    return rows.select("doc_id", doc.cast(S.DOCUMENT).alias("doc"))


def without(docs: DataFrame, gone: DataFrame, by: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(by, doc; fallback): documents without the items at the places gone (by, list, pos), every list kept in order. by: a document's key, doc_id last.

    A document that would break a rule without them stays as it was; fallback has its key and the rules. The places of a document are one small array, so items
    are filtered where they are and no list is taken apart."""
    places = gone.groupBy(*by).agg(F.collect_set(F.struct("list", "pos")).alias("_gone"))
    doc, ioc = F.col("doc"), F.col("doc")["indicators_of_compromise"]

    def left(items: Column, name: str) -> Column:
        return F.filter(items, lambda _, i: ~F.array_contains(F.col("_gone"), F.struct(F.lit(name).alias("list"), i.alias("pos"))))

    fields = S.DOCUMENT["indicators_of_compromise"].dataType
    lists = F.struct(*(left(ioc[f.name], f.name).alias(f.name) if f.name in S.INDICATORS else ioc[f.name].alias(f.name) for f in fields))
    changed = doc.withField("indicators_of_compromise", F.when(ioc.isNotNull(), lists)).withField("ttps", left(doc["ttps"], "ttps")).cast(S.DOCUMENT)
    rows = with_document(docs.select(*by, "doc"), places, by, "left").withColumn("_new", F.when(F.col("_gone").isNotNull(), changed))
    broken = F.when(F.col("_new").isNotNull() & (F.size(S.violations(doc)) == 0), S.violations(F.col("_new"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("violations", broken)
    fine = F.col("_new").isNotNull() & (F.size("violations") == 0)
    return rows.select(*by, F.when(fine, F.col("_new")).otherwise(doc).alias("doc")), rows.where(F.size("violations") > 0).select(*by, "violations")
