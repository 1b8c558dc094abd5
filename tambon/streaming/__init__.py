"""Parsing as a Structured Streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import AddressEngine


def parse_stream(engine: AddressEngine, messages: DataFrame, path: str, checkpoint: str, raw: str = "raw", once: bool = False) -> StreamingQuery:
    """Writes each new message's parse to Parquet below `path`; with `once`, all there is and then stops. Parsing keeps no state, so a restart goes on from `checkpoint`."""
    writer = engine.parse(messages, raw).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
