"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that content tokens leave out.
STOP_WORDS = (
    "a about also an and are as at be been being but by could did do does for from had has have if in into is it its may "
    "might no not of on or shall should so such than that the then these this those to use used using was were which who "
    "will with would"
).split()
# The length in hex digits of each kind of file hash; any other length counts as the last.
HASH_LENGTHS = {32: "MD5", 40: "SHA1", 64: "SHA256", 128: "SHA512"}
OTHER_HASH = "SHA256"
HASH_TYPES = ("MD5", "SHA1", "SHA256", "SHA512", "SSDEEP")
# The shapes of indicators.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
DOMAIN = r"\b[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z]{2,})+\b"
URL = "https?://[^\\s\"'<>]+"
CVE = r"(?i)\bCVE-[0-9]{4}-[0-9]{4,7}\b"
TECHNIQUE_ID = r"^T[0-9]{4}(\.[0-9]{1,3})?$"
EXCLUDED_DOMAINS = r"(?i)(microsoft\.com|google\.com|github\.com|example\.com|localhost)"
# Most characters of a report that a model sees, and of a summary.
CHARS_FREE_TEXT, CHARS_JSON, CHARS_SUMMARY = 10_000, 42_000, 1_500
SHORT_SNIPPET = 5


def strip(c: Column, unicode: bool = True) -> Column:
    """Without white space at both ends. trim() takes spaces alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$" if unicode else r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def truncate(c: Column, chars: int = CHARS_JSON) -> Column:
    return F.substring(c, 1, chars)


def claim_value(kind: Column, value: Column) -> Column:
    """A claim's value as it is compared: stripped, in lower case, CVE ids in upper case."""
    bare = strip(value)
    return F.when(kind == "cve", F.upper(bare)).otherwise(F.lower(bare))


def stored_value(kind: Column, value: Column) -> Column:
    """A claim's value as it is stored: only addresses, domains and hashes lose their case, CVE ids are in upper case."""
    bare = strip(value)
    return F.when(kind.isin("ip", "domain", "hash"), F.lower(bare)).when(kind == "cve", F.upper(bare)).otherwise(bare)


def pad_technique_id(c: Column, keep_case: bool = False) -> Column:
    """A technique id with its sub-technique padded to three digits: T1566.1 is T1566.001. Null and empty stay. With keep_case an id
    that is padded keeps its case, and every other is in upper case."""
    bare = strip(c)
    source = bare if keep_case else F.upper(bare)
    stem, sub = (F.regexp_extract(source, r"^([Tt][0-9]{4})\.([0-9]{1,2})$", i) for i in (1, 2))
    padded = F.concat(stem, F.lit("."), F.lpad(sub, 3, "0"))
    return F.when(c.isNull() | (c == ""), c).when(stem != "", padded).otherwise(F.upper(bare))


def tokens(c: Column, unicode: bool = True) -> Column:
    """Content words: lower case, signs to spaces, without stop words; repeats and order stay."""
    word = r"(?U)[^\w\s]" if unicode else r"[^a-zA-Z0-9_\s]"
    split = F.split(F.regexp_replace(F.lower(c), word, " "), r"(?U)\s+" if unicode else r"\s+")
    return F.filter(split, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def too_short(c: Column, unicode: bool = True) -> Column:
    return F.size(tokens(c, unicode)) < SHORT_SNIPPET


def hash_type(c: Column) -> Column:
    out = F
    for length, name in HASH_LENGTHS.items():
        out = out.when(F.length(c) == length, name)
    return out.otherwise(OTHER_HASH)


def ip_addresses(c: Column, labelled: bool = False) -> Column:
    """All IPv4 addresses of a text; labelled: with the label before them, if there is one, as part of them."""
    return F.regexp_extract_all(c, F.lit(rf"\b(?:IP:\s*)?(?:{OCTET}\.){{3}}{OCTET}\b" if labelled else IPV4), F.lit(0))


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(URL), F.lit(0))


def cves(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(CVE), F.lit(0)), F.upper)


def domains(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(c, F.lit(DOMAIN), F.lit(0)), F.lower)
    return F.filter(found, lambda d: ~d.rlike(EXCLUDED_DOMAINS))


def hashes(c: Column, digits: int) -> Column:
    """All runs of exactly so many hex digits."""
    return F.regexp_extract_all(c, F.lit(rf"\b([A-Fa-f0-9]{{{digits}}})\b"), F.lit(1))


def partial_date(c: Column) -> Column:
    """The first day of a year, quarter (2024-Q3), month or day, as a date; null for anything else."""
    year, quarter = F.regexp_extract(c, r"^([0-9]{4})", 1), F.regexp_extract(c, r"^[0-9]{4}-Q([1-4])$", 1)
    text = (
        F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c)
        .when(c.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(c, F.lit("-01")))
        .when(quarter != "", F.concat(year, F.lit("-"), F.lpad((F.expr("3") * quarter.try_cast("int") - 2).cast("string"), 2, "0"), F.lit("-01")))
        .when(c.rlike(r"^[0-9]{4}$"), F.concat(c, F.lit("-01-01")))
    )
    return F.try_to_date(text, "yyyy-MM-dd")
