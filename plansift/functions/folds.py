"""Order-dependent folds over long groups, one row at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS = 4096


def fold_sorted(
    rows: DataFrame, keys: list[str], order: list[str], items: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str,
) -> DataFrame:
    """``keys`` and what ``fold`` yields for the ``items`` of each group, which it reads in ``order``.

    Spark brings the rows of a group to one task, sorted; they stream through
    the fold, so a group of any length needs only the memory of the fold's own
    state. Folds drop from that state what no later row can change.
    """
    out = StructType([rows.schema[k] for k in keys] + StructType.fromDDL(schema).fields)
    n, arrow = len(keys), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = [pa.array(values, kind) for values, kind in zip(zip(*held, strict=True), arrow.types, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for key, group in groupby(stream, key=lambda row: row[:n]):
            for result in fold(row[n:] for row in group):
                held.append(key + result)
                if len(held) >= OUT_ROWS:
                    yield packed()
        if held:
            yield packed()

    sorted_rows = rows.select(*keys, *items).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(run, out)
