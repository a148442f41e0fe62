"""Folds over a key's rows in order, for rules that no window expresses: what is kept depends on what was kept before.

Rows are dealt by key and sorted (spilling where they must); a task carries one accumulator through the stream, so a key of any
size takes constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..session import reachable


def folded(rows: DataFrame, key: str, order: list[Column], value: str, start: Any, step: Callable[[Any, Any], tuple[Any, int]], out: str) -> DataFrame:
    """``rows`` with the long column ``out``: ``step(accumulator, value)`` gives the next accumulator and the row's number."""
    reachable(rows.sparkSession)
    names = rows.columns
    at_key, at_value = names.index(key), names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, carried = False, None, start
        for batch in batches:
            numbers = []
            for k, v in zip(batch.column(at_key).to_pylist(), batch.column(at_value).to_pylist(), strict=True):
                if not seen or k != held:
                    seen, held, carried = True, k, start
                carried, number = step(carried, v)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{schema}, `{out}` long")


def greedy(most: int) -> Callable[[int, int | None], tuple[int, int]]:
    """1 for a row that fits into what is left of ``most``, which it then takes, else 0; an unknown size is 0."""

    def step(spent: int, size: int | None) -> tuple[int, int]:
        size = size or 0
        return (spent + size, 1) if spent + size <= most else (spent, 0)

    return step


def packing(most: int) -> Callable[[tuple[int, int], int | None], tuple[tuple[int, int], int]]:
    """Batch numbers: a row goes into the open batch while that stays within ``most``, else into the next."""

    def step(at: tuple[int, int], size: int | None) -> tuple[tuple[int, int], int]:
        batch, spent = at
        size = size or 0
        if batch < 0 or spent + size > most:
            return (batch + 1, size), batch + 1
        return (batch, spent + size), batch

    return step
