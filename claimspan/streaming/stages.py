"""Per-document stages over a stream: they keep no state between documents, so a stream takes them as a table does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.claims import flatten
from ..operators.documents import parse_outputs


def claims_stream(raw: DataFrame) -> DataFrame:
    """Claims of the valid model outputs (doc_id, raw_output) of a stream; invalid ones go to quarantine_stream."""
    return flatten(parse_outputs(raw).where("size(violations) = 0").select("doc_id", "doc"))


def quarantine_stream(raw: DataFrame) -> DataFrame:
    return parse_outputs(raw).where("size(violations) > 0").select("doc_id", "raw_output", "violations")


def write_stream(df: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """All that is there now, then stop; appended to Parquet, or handed to `sink` batch by batch."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", path)).start()
