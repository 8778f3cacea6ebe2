"""Python work on rows: batches in as dicts, batches out by a declared schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows handed over at a time.
BATCH = 2000


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterable[dict]]], schema: str) -> DataFrame:
    """Each row to any number of rows. ``make`` runs once a task; keys that a result lacks are null."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, out = make(), []
        for b in batches:
            for row in b.to_pylist():
                out += work(row)
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, schema)
