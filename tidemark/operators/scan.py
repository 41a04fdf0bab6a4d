"""Ordered scans: rows of each key, in order, through a small state, as a stream of Arrow batches.

Rows are dealt by key and sorted within partitions; a task reads them batch by batch, so a key may have more rows than fit in
memory and many small keys share one batch. What a step returns comes out in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], fresh: Callable[[], object], schema: str | StructType, out_rows: int = 10_000) -> DataFrame:
    """``fresh()`` makes a state for each key with ``row(values) -> iterable of rows`` and ``end() -> iterable of rows``."""
    names = df.columns
    at = [names.index(k) for k in keys]
    parsed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(parsed)
        key, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(shape)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own = tuple(row[i] for i in at)
                if state is None or own != key:
                    if state is not None:
                        out.extend(state.end())
                    key, state = own, fresh()
                out.extend(state.row(row))
                if len(out) >= out_rows:
                    yield flush()
                    out.clear()
        if state is not None:
            out.extend(state.end())
        yield flush()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, parsed)
