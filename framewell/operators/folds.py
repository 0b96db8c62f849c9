"""Recurrences and greedy selection as scans over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def values(column: pa.Array) -> list:
    """What ``column.to_pylist()`` gives. Numbers without nulls go by way of numpy, and lists and structs of them by their parts,
    which is several times as fast."""
    kind = column.type
    if column.null_count == 0 and len(column):
        if pa.types.is_floating(kind) or pa.types.is_integer(kind):
            return column.to_numpy(zero_copy_only=False).tolist()
        if pa.types.is_struct(kind) and kind.num_fields:
            names = [f.name for f in kind]
            return [dict(zip(names, v, strict=True)) for v in zip(*map(values, column.flatten()), strict=True)]
        if pa.types.is_list(kind):
            items, ends = values(column.flatten()), list(accumulate(values(column.value_lengths()), initial=0))
            return [items[a:b] for a, b in pairwise(ends)]
    return column.to_pylist()


def ordered_scan(df: DataFrame, keys: list[str], order: list[str | Column], uses: list[str], make: Callable[[], Callable[..., tuple]], schema: str, arranged: bool = False) -> DataFrame:
    """Run a recurrence over each key's rows in order, and add what it gives for each row as the columns of ``schema``.

    ``make`` gives a function with fresh state for a key; it is called with the columns ``uses`` of one row after the other.
    Rows stream through sorted partitions: a task holds one batch and one key's state, never a whole key. Other columns pass
    as Arrow arrays. ``arranged``: rows come from an earlier scan by the same keys and order, with nothing but projections between,
    and stay as they are, so that they are not shuffled and sorted again.
    """
    fields = T.StructType.fromDDL(schema)
    out = T.StructType([*df.schema.fields, *fields.fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            made = []
            columns = [values(batch.column(batch.schema.get_field_index(c))) for c in [*keys, *uses]]
            for row in zip(*columns, strict=True):
                own = row[: len(keys)]
                if step is None or own != key:
                    key, step = own, make()
                made.append(step(*row[len(keys) :]))
            columns = list(zip(*made, strict=True)) if made else [()] * len(fields)
            extra = [pa.array(c, _ARROW[f.dataType.simpleString()]) for c, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=out.names)

    return (df if arranged else df.repartition(*keys).sortWithinPartitions(*keys, *order)).mapInArrow(run, out)


_ARROW = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
