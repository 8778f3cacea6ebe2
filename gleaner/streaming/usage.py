"""Usage states over a stream of marks, with the batch operator's own semantics.

An extension: audits are batch jobs. The strongest state of a key only grows, so an update-mode aggregate needs no
watermark; state is one number a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.groups import merge_usage


def watch_usage(marks: DataFrame, key: list[str], name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keep the in-memory table ``name`` at the strongest status of each key seen so far."""
    writer = merge_usage(marks, key).writeStream.outputMode("complete").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
