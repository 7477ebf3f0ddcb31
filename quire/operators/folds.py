"""Ordered folds over groups of any size: sorted partitions are streamed, a group is never gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def ordered_fold(df: DataFrame, key: list[str], order: list[str], schema: StructType | str, begin: Callable[[tuple], Any]) -> DataFrame:
    """Feeds each group's rows, in order, to the object that begin(key) makes.

    The object has step(row) -> rows to give out now, and end() -> rows to give out after the last; a row is a dict in,
    a tuple out. Groups are told apart by their key in the sorted stream, so memory holds one state.

    Rows are dealt by a hash of the key, which no input is dealt by already: over a union of inputs dealt by the key itself
    Spark would leave the shuffle out and then coalesce each input's partitions apart, so that a group's rows did not meet.
    """
    names = df.columns
    out_schema = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = None, None
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                here = tuple(row[k] for k in key)
                if state is None or here != at:
                    if state is not None:
                        rows.extend(state.end())
                    state, at = begin(here), here
                rows.extend(state.step(row))
            yield made(rows)
        if state is not None:
            yield made(state.end())

    def made(rows) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(out_schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    dealt = df.repartition(F.xxhash64(*key)).sortWithinPartitions(*key, *order).select(*names)
    return dealt.mapInArrow(run, schema)
