"""Staged repair of the JSON that a model wrote, as Column expressions; null is failure."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def outermost_object(c: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    found = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def sanitise(c: Column) -> Column:
    """Backslashes that begin no escape are doubled, then commas before a closing bracket go."""
    return F.regexp_replace(F.regexp_replace(c, r'\\(?!["\\/bfnrtu])', r"\\\\"), r",\s*([}\]])", "$1")


def insert_commas(c: Column) -> Column:
    """A comma between two values that only a line break parts."""
    # Fixed value: what may end a value here is any of these characters. What follows a gap is only looked at, so one pass mends every gap of a run.
    return F.regexp_replace(c, r'(["0-9\]}truefalsn\x08])(\s*\n\s*)(?=["\[{])', "$1,$2")


@F.pandas_udf(T.StringType())
def longest_object(texts: pd.Series) -> pd.Series:
    """The longest prefix that is a JSON object: a decoder reads one value and says where it ends."""
    decoder = json.JSONDecoder()

    def first(text: str | None) -> str | None:
        try:
            return text[: decoder.raw_decode(text)[1]] if text else None
        except ValueError:
            return None

    return texts.map(first)


def is_json(c: Column) -> Column:
    """Whether a text is one JSON value. As the one item of an array: the parser alone would overlook what follows a value."""
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull()


def last_resort(c: Column) -> Column:
    """The longest object that the mended text begins with."""
    return longest_object(insert_commas(sanitise(outermost_object(c))))


def local_repair(c: Column) -> Column:
    """struct<json, strategy>: the first of direct, sanitised, commas that parses, or null. A stage is tried only if those before it fail."""

    def bound(text: Column, use) -> Column:
        # Each stage's text is bound once; its uses would each repair it again.
        return F.get(F.transform(F.array(text), use), 0)

    def stage(name: str):
        return lambda text: F.when(is_json(text), F.struct(text.alias("json"), F.lit(name).alias("strategy")))

    def steps(direct: Column) -> Column:
        mended = bound(sanitise(direct), lambda clean: F.coalesce(stage("sanitised")(clean), bound(insert_commas(clean), stage("commas"))))
        return F.coalesce(stage("direct")(direct), mended)

    return bound(outermost_object(c), steps)


def repair(c: Column) -> Column:
    """struct<json, strategy>: the first of direct, sanitised, commas, prefix that parses; both null if none does."""
    prefix, local = last_resort(c), local_repair(c)
    last = F.when(prefix.isNotNull(), F.struct(prefix.alias("json"), F.lit("prefix").alias("strategy")))
    none = F.struct(F.lit(None).cast("string").alias("json"), F.lit(None).cast("string").alias("strategy"))
    return F.coalesce(local, last, none)
