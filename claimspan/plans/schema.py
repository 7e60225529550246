"""The document schema, fixed in code, and its rules as a list of violations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CHARS_SUMMARY, HASH_TYPES, TECHNIQUE_ID, is_blank

# The enumerations and patterns of the document.
REPORT_TYPES = ("incident", "campaign", "strategic")
CONFIDENCES = ("high", "medium", "low")
CONTEXTS = ("observed", "detection_rule_only", "uncertain")
MAPPINGS = ("explicit", "inferred")
PRECISIONS = ("day", "month", "quarter", "year", "approximate")
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _struct(*names: str, **kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(n, k) for n, k in kinds.items()])


_VALUE = ("value", "evidence_snippet", "source_context")
_NAMED = T.ArrayType(_struct("name", "evidence_snippet"))
#: The lists of indicators: list name -> (claim type, field of its value).
INDICATORS = {"ip_addresses": ("ip", "value"), "domains": ("domain", "value"), "file_hashes": ("hash", "value"), "urls": ("url", "value"), "http_paths": ("path", "value"), "tools": ("tool", "name"), "cves": ("cve", "value")}
DOCUMENT = T.StructType([
    T.StructField("report_metadata", _struct("report_type", "report_title")),
    T.StructField("threat_actor", T.StructType([T.StructField("name", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("confidence", T.StringType())])),
    T.StructField("campaign_name", T.StringType()),
    T.StructField("target_sectors", T.ArrayType(T.StringType())),
    T.StructField("indicators_of_compromise", T.StructType([
        T.StructField("ip_addresses", T.ArrayType(_struct(*_VALUE))),
        T.StructField("domains", T.ArrayType(_struct(*_VALUE, masked=T.BooleanType(), phishing_template=T.BooleanType()))),
        T.StructField("file_hashes", T.ArrayType(_struct("value", "hash_type", "evidence_snippet", "source_context"))),
        T.StructField("urls", T.ArrayType(_struct(*_VALUE))),
        T.StructField("http_paths", T.ArrayType(_struct(*_VALUE))),
        T.StructField("tools", _NAMED),
        T.StructField("cves", T.ArrayType(_struct(*_VALUE))),
        T.StructField("detection_signatures", T.StructType([T.StructField("yara_rules", _NAMED), T.StructField("sigma_rules", _NAMED)])),
    ])),
    T.StructField("ttps", T.ArrayType(_struct("mitre_id", "tactic", "technique", "evidence_snippet", "mapping_type", "mitre_confidence", "evidence_location"))),
    T.StructField("summary", T.StringType()),
    T.StructField("timeline", T.ArrayType(_struct("date", "date_precision", "event", "evidence_snippet"))),
])


def parse(json: Column) -> Column:
    """A JSON text as a document; unknown keys are ignored, absent ones null."""
    return F.from_json(json, DOCUMENT)


def _any(items: Column, bad) -> Column:
    """Whether an item breaks a rule; an absent list breaks none."""
    return F.coalesce(F.exists(items, bad), F.lit(False))


def _lacks(field: str):
    """Whether an item is without its value or its snippet."""
    return lambda item: item[field].isNull() | (item[field] == "") | item["evidence_snippet"].isNull() | (item["evidence_snippet"] == "")


def violations(doc: Column) -> Column:
    """_broken, with the document bound once: its many uses would each parse it again."""
    return F.get(F.transform(F.array(doc), _broken), 0)


def _broken(doc: Column) -> Column:
    """The rules that a document (a DOCUMENT struct) breaks, as an array of names; empty if it is valid. A null document breaks `object`."""
    ioc = doc["indicators_of_compromise"]
    outside = lambda c, values: c.isNotNull() & ~c.isin(*values)
    missing = lambda c: c.isNull() | (c == "")
    rules = {
        "object": doc.isNull(),
        "report_metadata": doc.isNotNull() & doc["report_metadata"].isNull(),
        "report_type": doc["report_metadata"].isNotNull() & F.coalesce(~doc["report_metadata"]["report_type"].isin(*REPORT_TYPES), F.lit(True)),
        "indicators": doc.isNotNull() & ioc.isNull(),
        "summary": doc.isNotNull() & (doc["summary"].isNull() | (F.length(doc["summary"]) > CHARS_SUMMARY)),
        "actor_confidence": doc["threat_actor"].isNotNull() & F.coalesce(~doc["threat_actor"]["confidence"].isin(*CONFIDENCES), F.lit(True)),
        "actor_name": doc["threat_actor"].isNotNull() & missing(doc["threat_actor"]["name"]),
        "sectors": _any(doc["target_sectors"], is_blank),
        "ttp_fields": _any(doc["ttps"], lambda t: missing(t["tactic"]) | missing(t["technique"]) | missing(t["evidence_snippet"])),
        "ttp_id": _any(doc["ttps"], lambda t: t["mitre_id"].isNotNull() & ~t["mitre_id"].rlike(TECHNIQUE_ID)),
        "ttp_confidence": _any(doc["ttps"], lambda t: outside(t["mitre_confidence"], CONFIDENCES)),
        "ttp_mapping": _any(doc["ttps"], lambda t: outside(t["mapping_type"], MAPPINGS)),
        "timeline_date": _any(doc["timeline"], lambda t: F.coalesce(~t["date"].rlike(DATE), F.lit(True))),
        "timeline_fields": _any(doc["timeline"], lambda t: missing(t["event"]) | missing(t["evidence_snippet"])),
        "timeline_precision": _any(doc["timeline"], lambda t: outside(t["date_precision"], PRECISIONS)),
        "hash_type": _any(ioc["file_hashes"], lambda h: F.coalesce(~h["hash_type"].isin(*HASH_TYPES), F.lit(True))),
    }
    for name, (_, value) in INDICATORS.items():
        rules[name] = _any(ioc[name], _lacks(value))
        if value == "value":
            rules[f"{name}_context"] = _any(ioc[name], lambda i: outside(i["source_context"], CONTEXTS))
    for name in ("yara_rules", "sigma_rules"):
        rules[name] = _any(ioc["detection_signatures"][name], _lacks("name"))
    return F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items())), lambda v: v.isNotNull())
