"""Aggregates: Spark's own by name, and the user's own as accumulators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAMED: dict[str, Callable[[str], Column]] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}
#: So many keys are held in a task before their accumulators are passed on.
KEYS_HELD = 50_000


class Accumulator:
    """A user's aggregate: tasks start and merge accumulators, an exchange brings those of a key together.

    ``fields`` are the accumulator's columns and ``result`` the aggregate's type, both as DDL; ``empty`` is what a
    global aggregate gives on no rows.
    """

    fields: str
    result: str
    empty: Any = None

    def start(self, values: pa.Array) -> tuple:
        """The accumulator of some rows' values, nulls included."""
        raise NotImplementedError

    def merge(self, states: Sequence[tuple]) -> tuple:
        """One accumulator of several; the order may be any."""
        raise NotImplementedError

    def finish(self, state: tuple) -> Any:
        raise NotImplementedError


Aggregates = Mapping[str, tuple[str | Accumulator, str]]


def aggregated(df: DataFrame, keys: Sequence[str], aggregates: Aggregates) -> DataFrame:
    """A row per key, or one row over everything where there are no keys; either all by name or all accumulators."""
    own = {name: a for name, a in aggregates.items() if isinstance(a[0], Accumulator)}
    if not own:
        if unknown := sorted({str(how) for how, _ in aggregates.values()} - set(NAMED)):
            raise ValueError(f"unknown aggregates {unknown}; there are {sorted(NAMED)}")
        columns = [NAMED[how](column).alias(name) for name, (how, column) in aggregates.items()]
        return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
    if len(own) < len(aggregates):
        raise ValueError("named aggregates and accumulators are asked for apart")
    return _accumulated(df, list(keys), [(name, how, column) for name, (how, column) in own.items()])


def _accumulated(df: DataFrame, keys: list[str], own: list[tuple[str, Accumulator, str]]) -> DataFrame:
    of_keys = df.select(*keys).schema if keys else StructType()
    fields = [StructType.fromDDL(how.fields) for _, how, _ in own]
    # Accumulator columns are named after their aggregate, so that they don't clash.
    state = StructType([*of_keys.fields, *(type(f)(f"__{name}_{f.name}", f.dataType) for (name, _, _), s in zip(own, fields, strict=True) for f in s.fields)])
    out = StructType([*of_keys.fields, *(type(f)(name, f.dataType) for name, how, _ in own for f in StructType.fromDDL(f"v {how.result}").fields)])
    spans, at = [], 0
    for s in fields:
        spans.append((at, at + len(s.fields)))
        at += len(s.fields)
    hows, columns = [how for _, how, _ in own], [column for _, _, column in own]
    arrow_state, arrow_out = to_arrow_schema(state), to_arrow_schema(out)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple]] = {}

        def passed_on() -> pa.RecordBatch:
            rows = [(*key, *(x for one in states for x in one)) for key, states in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow_state, strict=True)], schema=arrow_state)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key, rows in _by_key(table, keys):
                started = [how.start(rows.column(c).combine_chunks()) for how, c in zip(hows, columns, strict=True)]
                had = held.get(key)
                held[key] = started if had is None else [how.merge([a, b]) for how, a, b in zip(hows, had, started, strict=True)]
            if len(held) >= KEYS_HELD:
                yield passed_on()
        if held:
            yield passed_on()

    def merged(table: pa.Table) -> pa.Table:
        columns = [c.to_pylist() for c in table.columns]
        values = []
        for how, (a, b) in zip(hows, spans, strict=True):
            states = list(zip(*columns[len(keys) + a : len(keys) + b], strict=True))
            # The row that stands for no rows has no accumulator.
            states = [s for s, real in zip(states, columns[-1], strict=True) if real] if not keys else states
            values.append(how.finish(how.merge(states) if len(states) > 1 else states[0]) if states else how.empty)
        row = [*(columns[i][0] for i in range(len(keys))), *values]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow_out, strict=True)], schema=arrow_out)

    parts = df.select(*dict.fromkeys([*keys, *columns])).mapInArrow(partials, from_arrow_schema(arrow_state))
    if keys:
        return parts.groupBy(*keys).applyInArrow(merged, from_arrow_schema(arrow_out))
    nothing = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in state.fields], F.lit(False).alias("__real"))
    return parts.withColumn("__real", F.lit(True)).unionByName(nothing).groupBy().applyInArrow(merged, from_arrow_schema(arrow_out))


def _by_key(table: pa.Table, keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    if not keys:
        if table.num_rows:
            yield (), table
        return
    numbered = table.select(keys).append_column("__row", pa.array(range(table.num_rows), pa.int64()))
    groups = numbered.group_by(keys).aggregate([("__row", "list")])
    places = groups.column("__row_list").combine_chunks()
    for i, key in enumerate(zip(*(groups.column(k).to_pylist() for k in keys), strict=True)):
        yield key, table.take(places[i].values)
