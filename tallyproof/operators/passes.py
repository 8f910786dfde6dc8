"""One pass over the rows of each group in order, with a little state carried from row to row."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def ordered_pass(rows: DataFrame, group: list[str], order: list[str], inputs: list[str], start: Callable[[], Callable], name: str, ddl: str, kind: pa.DataType) -> DataFrame:
    """rows with a further column ``name`` (``ddl``, in Arrow ``kind``): ``start()`` opens a group and gives the function that
    is called with each row's ``inputs``, in order.

    Spark brings a group's rows together and sorts them; they stream through in Arrow batches, so that a task holds one
    batch and one group's state, whatever the group's size. Time is linear in the rows.
    """
    sorted_ = rows.repartition(*group).sortWithinPartitions(*group, *order)

    def walk(batches):
        key, step = None, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in group))
            values = zip(*(batch.column(c).to_pylist() for c in inputs))
            out = []
            for k, v in zip(keys, values):
                if step is None or k != key:
                    key, step = k, start()
                out.append(step(*v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, name])

    return sorted_.mapInArrow(walk, StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} {ddl}").fields]))
