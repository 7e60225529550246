"""Shared folders, materialised intermediates and size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..store import discard, folder, materialise, no_shuffle_left, remove  # noqa: F401

#: The ASCII white space that the text contracts name: space, tab, LF, VT, FF, CR.
ASCII_WS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, with just the columns that the caller uses."""
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows: one scan and one small row."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def blocks_of(total: int, size: int, least: int = 1) -> int:
    """How many blocks of `size` hold `total`."""
    return max(least, -(-total // max(1, size)))
