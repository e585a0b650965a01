"""Sequential recurrences per key, as one sorted pass per partition.

A recurrence that reads its own last decision cannot be split inside one key.  Rows are hashed by
key, sorted by key and order by Spark, and streamed through Arrow batches, so a task never holds a
key's history.  Time is cut into slices of bounded size as well: the state at the end of a slice
is written and handed to the next, which bounds the work that a lost executor can cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwise.session import spread, write_through

# batches of one partition, sorted by key and order -> output batches
Walk = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
CARRIED = "carried_"


def bounded_slices(
    rows: DataFrame, keys: Sequence[str], slice_col: str, max_rows: int
) -> list[tuple[int, int]]:
    """Ranges of ``slice_col`` in which no key can have more than about ``max_rows`` rows.

    Only one number per time slice reaches the driver.  The ranges add up the largest key of each
    slice; they are never shorter than one slice.
    """
    largest = (
        rows.groupBy(slice_col, *keys)
        .count()
        .groupBy(slice_col)
        .agg(F.max("count").alias("largest"))
        .orderBy(slice_col)
        .collect()
    )
    ranges: list[tuple[int, int]] = []
    filled = 0
    for number, size in largest:
        if ranges and filled + size <= max_rows:
            ranges[-1] = (ranges[-1][0], number)
            filled += size
        else:
            ranges.append((number, number))
            filled = size
    return ranges


def fold_slice(
    rows: DataFrame,
    state: DataFrame | None,
    keys: Sequence[str],
    order: Sequence[str],
    walk: Walk,
    schema: T.StructType,
    state_columns: Sequence[str],
) -> DataFrame:
    """Fold one slice; every row brings its key's state before the slice (null if none)."""
    if state is None:
        kinds = {f.name: f.dataType for f in schema.fields}
        rows = rows.withColumns(
            {CARRIED + c: F.lit(None).cast(kinds[c]) for c in state_columns}
        )
    else:
        carried = state.select(*keys, *[F.col(c).alias(CARRIED + c) for c in state_columns])
        rows = rows.join(carried, list(keys), "left")
    arranged = spread(rows, *keys).sortWithinPartitions(*keys, *order)
    return arranged.mapInArrow(walk, schema)


def end_states(
    folded: DataFrame,
    state: DataFrame | None,
    keys: Sequence[str],
    order: Sequence[str],
    state_columns: Sequence[str],
) -> DataFrame:
    """State of every key after a slice: that of its last row, else what it had before."""
    last = F.max_by(F.struct(*state_columns), F.struct(*order))
    latest = folded.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")
    if state is None:
        return latest
    idle = state.select(*keys, *state_columns).join(latest.select(*keys), list(keys), "left_anti")
    return latest.unionByName(idle)


def fold_by_key(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    walk: Walk,
    schema: T.StructType,
    state_columns: Sequence[str],
    *,
    slice_col: str,
    max_rows: int,
    sized: tuple[DataFrame, Sequence[str]] | None = None,
) -> DataFrame:
    """Fold every key in order; one lazy pass if all keys are small, else slice after slice.

    ``sized``: a table and its keys that tell how many rows a key has in a slice, if there is a cheaper
    one than ``rows``.
    """
    ranges = bounded_slices(*(sized or (rows, keys)), slice_col, max_rows)
    if len(ranges) <= 1:
        return fold_slice(rows, None, keys, order, walk, schema, state_columns)
    state, parts = None, []
    for first, last in ranges:
        part = rows.where(F.col(slice_col).between(first, last))
        folded = write_through(
            fold_slice(part, state, keys, order, walk, schema, state_columns), "fold"
        )
        parts.append(folded)
        state = write_through(
            end_states(folded, state, keys, order, state_columns), "fold-state"
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.DoubleType):
        return pa.float64()
    if isinstance(kind, T.LongType):
        return pa.int64()
    if isinstance(kind, T.BooleanType):
        return pa.bool_()
    return pa.string()


def listed(column: pa.Array) -> list:
    """The values of a column as Python has them; those of numbers without a detour by Arrow's scalars."""
    if pa.types.is_string(column.type):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    values = pc.fill_null(column, False if pa.types.is_boolean(column.type) else 0)
    values = values.to_numpy(zero_copy_only=False).tolist()
    for i in pc.indices_nonzero(column.is_null()).to_pylist():
        values[i] = None
    return values


def runs_of_keys(batch: pa.RecordBatch, keys: Sequence[str]) -> list[int]:
    """Rows at which another key begins, and the number of rows; none for an empty batch."""
    if not batch.num_rows:
        return []
    other = np.zeros(batch.num_rows, bool)
    other[0] = True
    for name in keys:
        codes = pc.dictionary_encode(batch.column(name), null_encoding="encode").indices.to_numpy()
        other[1:] |= codes[1:] != codes[:-1]
    return [*np.flatnonzero(other).tolist(), batch.num_rows]


def keys_at(batch: pa.RecordBatch, keys: Sequence[str], rows: Sequence[int]) -> Iterator[tuple]:
    """The keys of some rows."""
    places = pa.array(rows, pa.int64())
    return zip(*[batch.column(name).take(places).to_pylist() for name in keys], strict=True)


def with_results(
    batch: pa.RecordBatch,
    kept: Sequence[str],
    fields: Sequence[T.StructField],
    rows: list[tuple],
) -> pa.RecordBatch:
    """The kept input columns of a batch followed by result columns given row by row."""
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    made = [
        pa.array(values, arrow_type(f.dataType))
        for values, f in zip(columns, fields, strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(n) for n in kept], *made], names=[*kept, *[f.name for f in fields]]
    )
