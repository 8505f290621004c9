"""Sums of outer products of packed rows, for each block of rows: dense inside a task, added line by line between tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Packed rows that are dense at once (16 MB at most for 4,000 columns).
ROWS_AT_ONCE = 512
#: Columns of a symmetric product that are multiplied with all that follow.
COLUMNS_AT_ONCE = 384
#: Lines of a product in one Arrow batch (2 MB at most).
LINES_AT_ONCE = 64


def dense_rows(batch: pa.RecordBatch, width: int, k: str = "k", v: str = "v") -> np.ndarray:
    """Column numbers and values of a batch as dense rows; values of one column that occurs twice in a row add up."""
    numbers, values = batch.column(k), batch.column(v)
    out = np.zeros((batch.num_rows, width))
    at = np.repeat(np.arange(batch.num_rows), np.diff(numbers.offsets.to_numpy()))
    np.add.at(out, (at, numbers.flatten().to_numpy()), values.flatten().to_numpy())
    return out


def one_block_at_once(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = ROWS_AT_ONCE) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of at most ``most`` rows with the same keys, as far as they follow each other."""
    for batch in batches:
        found = list(zip(*[batch.column(c).to_pylist() for c in keys], strict=True))
        begin = 0
        for end in range(1, len(found) + 1):
            if end == len(found) or found[end] != found[begin] or end - begin == most:
                yield found[begin], batch.slice(begin, end - begin)
                begin = end


def line_batches(keys: list[str], key: tuple, total: np.ndarray, triangle: bool = False, types: list[pa.DataType] | None = None) -> Iterator[pa.RecordBatch]:
    """(*keys, k, line): the lines of a matrix, some at a time; with ``triangle`` line k begins at column k."""
    for at in range(0, len(total), LINES_AT_ONCE):
        ks = list(range(at, min(at + LINES_AT_ONCE, len(total))))
        lines = [total[k, k if triangle else 0 :] for k in ks]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)
        kinds = types or [pa.string() if isinstance(part, str) else pa.int32() for part in key]
        columns = [pa.array([part] * len(ks), kind) for part, kind in zip(key, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ks, pa.int32()), pa.ListArray.from_arrays(offsets, np.concatenate(lines))], names=[*keys, "k", "line"])


def sum_lines(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (*keys, k, line) of the same keys and k added up, one at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(parts.schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0)

        def emit() -> pa.RecordBatch:
            columns = [pa.array([part], arrow.field(c).type) for c, part in zip([*keys, "k"], now, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([total], arrow.field("line").type)], schema=arrow)

        for batch in batches:
            lines = batch.column("line")
            for j, key in enumerate(zip(*[batch.column(c).to_pylist() for c in (*keys, "k")], strict=True)):
                line = lines[j].values.to_numpy()
                if key == now:
                    total = total + line
                else:
                    if now is not None:
                        yield emit()
                    now, total = key, line
        if now is not None:
            yield emit()

    return parts.select(*keys, "k", "line").repartition(*keys, "k").sortWithinPartitions(*keys, "k").mapInArrow(add, T.StructType([*[parts.schema[c] for c in keys], parts.schema["k"], parts.schema["line"]]))


def product_lines(rows: DataFrame, keys: list[str], deal_by: str, width: Callable[[tuple], int]) -> DataFrame:
    """(*keys, k, line): line k of the sum of weight * (k, v)' (k, v) over the rows of each block, from column k on.

    ``rows`` are dealt by ranges of the keys and ``deal_by``, so that a task holds few blocks and its products are hardly larger than what it read; a hot
    block spreads over many tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([rows.schema[c] for c in keys]).add("k", T.IntegerType()).add("line", T.ArrayType(T.DoubleType()))
    kinds = [to_arrow_schema(schema).field(c).type for c in keys]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros((0, 0))
        for key, part in one_block_at_once(batches, keys):
            n = width(key)
            if key != now:
                yield from line_batches(keys, now or (), total, True, kinds)
                now, total = key, np.zeros((n, n))
            y = dense_rows(part, n)
            x = y * part.column("weight").to_numpy()[:, None]
            # the upper triangle is enough
            for at in range(0, n, COLUMNS_AT_ONCE):
                total[at : at + COLUMNS_AT_ONCE, at:] += x[:, at : at + COLUMNS_AT_ONCE].T @ y[:, at:]
        yield from line_batches(keys, now or (), total, True, kinds)

    parts = rows.repartitionByRange(*keys, deal_by).sortWithinPartitions(*keys).select(*keys, "weight", "k", "v").mapInArrow(multiply, schema)
    return sum_lines(parts, keys)
