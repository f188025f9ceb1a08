"""Folds over ordered rows, for rules where what became of one row decides about the next."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def ordered_fold(df: DataFrame, key: str, order: Sequence[str | Column], inputs: Sequence[str], step: Callable[..., tuple[Any, Any]], out: T.StructField) -> DataFrame:
    """``df`` with the column ``out``: ``step(state, *inputs)`` gives the next state and the row's value, beginning with
    the state None at each key's first row in ``order``.

    A key's rows come sorted to one task, which sees them batch by batch and holds no more than the state."""
    schema, kind = T.StructType([*df.schema.fields, out]), pa.bool_() if out.dataType == T.BooleanType() else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for batch in batches:
            values = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *inputs)), strict=True):
                if not begun or k != last:
                    last, state, begun = k, None, True
                state, value = step(state, *row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], [*batch.schema.names, out.name])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
