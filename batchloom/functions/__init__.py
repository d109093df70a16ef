"""Batch functions that queries and tests share; classes are made once per worker."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import xor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext

from batchloom.operators.aggregates import Accumulator


class AddFeature:
    """A new column: another one times a multiplier."""

    def __init__(self, source: str, name: str = "feature", multiplier: int = 7):
        self.source, self.name, self.multiplier = source, name, multiplier

    def __call__(self, batch: pa.Table) -> pa.Table:
        return batch.append_column(self.name, pc.multiply(batch.column(self.source).cast(pa.int64()), self.multiplier))


def add_to(batch: pa.Table, column: str, amount: int) -> pa.Table:
    """A column plus an amount, in place."""
    i = batch.column_names.index(column)
    return batch.set_column(i, column, pc.add(batch.column(column), pa.scalar(amount, batch.column(column).type)))


def multiply_by(batch: pa.Table, column: str, factor: int) -> pa.Table:
    """A column times a factor, in place."""
    i = batch.column_names.index(column)
    return batch.set_column(i, column, pc.multiply(batch.column(column), pa.scalar(factor, batch.column(column).type)))


def in_halves(batch: pa.Table) -> Iterator[pa.Table]:
    """The batch as two results."""
    half = batch.num_rows // 2
    yield batch.slice(0, half)
    yield batch.slice(half)


def keep_above(batch: pa.Table, column: str, least: float) -> pa.Table:
    """Rows whose column is above a value."""
    return batch.filter(pc.greater(batch.column(column), least))


def repeated(batch: pa.Table, column: str) -> pa.Table:
    """Every row as often as its column says."""
    times = batch.column(column).to_numpy()
    import numpy as np

    return batch.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))


def nothing(batch: pa.Table) -> pa.Table:
    """No rows, with the columns of the batch."""
    return batch.slice(0, 0)


def batch_length(batch: pa.Table) -> pa.Table:
    """One row: how many rows the batch has."""
    return pa.table({"n": pa.array([batch.num_rows], pa.int64())})


def key_sum(group: pa.Table, key: str, value: str) -> pa.Table:
    """One row per group: its key and the sum of a column."""
    return pa.table({key: group.column(key).slice(0, 1), "total": pa.array([pc.sum(group.column(value)).as_py()], pa.int64())})


async def add_later(batch: pa.Table, column: str, amount: int) -> pa.Table:
    """Like ``add_to``, but not synchronous."""
    return add_to(batch, column, amount)


def gang_members(batch: pa.Table) -> pa.Table:
    """One row: this task's number, how many tasks its stage has, and those that met at the barrier."""
    context = BarrierTaskContext.get()
    met = context.allGather(str(context.partitionId()))
    return pa.table({"task": pa.array([context.partitionId()], pa.int32()), "tasks": pa.array([len(context.getTaskInfos())], pa.int32()), "met": [",".join(sorted(met))]})


class BitXor(Accumulator):
    """All values by exclusive or; 0 on no values."""

    fields, result, empty = "bits long", "long", 0

    def start(self, values: pa.Array) -> tuple:
        return (reduce(xor, values.drop_null().to_pylist(), 0),)

    def merge(self, states: Sequence[tuple]) -> tuple:
        return (reduce(xor, (s[0] for s in states)),)

    def finish(self, state: tuple) -> int:
        return state[0]


class Spread(Accumulator):
    """The largest value less the smallest; null without values."""

    fields, result = "least double, most double", "double"

    def start(self, values: pa.Array) -> tuple:
        found = pc.min_max(values)
        return found["min"].as_py(), found["max"].as_py()

    def merge(self, states: Sequence[tuple]) -> tuple:
        some = [s for s in states if s[0] is not None]
        return (min(s[0] for s in some), max(s[1] for s in some)) if some else (None, None)

    def finish(self, state: tuple) -> float | None:
        return None if state[0] is None else state[1] - state[0]
