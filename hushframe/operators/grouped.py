"""Small sequential work per group: a document's pages, a page's rects.

Groups are gathered as arrays of structs and handed to a Python function in Arrow batches, many groups a batch, so
that the cost of a group is the function's own.  For groups that a task can hold: what one document or page has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Rows = list[dict]


def per_group(df: DataFrame, keys: list[str], work: Callable[[dict, Rows], Rows], schema: str | StructType) -> DataFrame:
    """What ``work(key values, rows)`` gives for each group; rows hold the other columns, in no order."""
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("_rows"))
    return _worked(grouped.select(*keys, "_rows"), keys, lambda row: row["_rows"], work, schema)


def per_row(df: DataFrame, keys: list[str], work: Callable[[dict, Rows], Rows], schema: str | StructType) -> DataFrame:
    """What ``work(key values, [row])`` gives for each row, which already holds all of its group."""
    return _worked(df, keys, lambda row: [row], work, schema)


def _worked(df: DataFrame, keys: list[str], rows: Callable[[dict], Rows], work: Callable[[dict, Rows], Rows], schema: str | StructType) -> DataFrame:
    out = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                found: Rows = []
                for row in batch.slice(lo, 1000).to_pylist():
                    found += work({k: row[k] for k in keys}, rows(row))
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return df.mapInArrow(run, out)
