"""What runs inside a task: rebatching, calling user functions, and the chain of a region."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from types import GeneratorType
from typing import Any

import pyarrow as pa

#: Callable objects by plan and stage. Spark reuses worker processes, so one is made per worker, not per task.
_instances: dict[tuple[str, int], Any] = {}
_last_used: dict[tuple[str, int], float] = {}
#: Objects that no batch has needed for so long go, in seconds; they belong to plans that are over.
IDLE = 1_800.0


class BatchError(RuntimeError):
    """The user's function failed; its own error is the cause."""


@dataclass(frozen=True)
class MapConfig:
    """One map stage. ``key`` names the stage, so that workers can keep its callable object."""

    fn: Any
    batch_size: int | None
    batch_format: str
    schema: pa.Schema
    key: tuple[str, int]
    zero_copy: bool = False
    args: tuple = ()
    kwargs: tuple[tuple[str, Any], ...] = ()
    constructor_args: tuple = ()
    constructor_kwargs: tuple[tuple[str, Any], ...] = ()
    raise_original: bool = False

    def __post_init__(self) -> None:
        size = self.batch_size
        if size is not None and (not isinstance(size, int) or isinstance(size, bool) or size <= 0):
            raise ValueError("batch_size is a positive integer")
        for pairs in (self.kwargs, self.constructor_kwargs):
            if len({k for k, _ in pairs}) != len(pairs):
                raise ValueError("a keyword is given twice")


def rebatched(tables: Iterable[pa.Table], size: int | None) -> Iterator[pa.Table]:
    """Batches of exactly ``size`` rows across the borders of ``tables``, the rest last; empty ones are skipped.

    Without a size, each table is a batch.
    """
    held: list[pa.Table] = []
    rows = 0
    for table in tables:
        if not table.num_rows:
            continue
        if size is None:
            yield table
            continue
        at = 0
        while rows + table.num_rows - at >= size:
            take = size - rows
            held.append(table.slice(at, take))
            yield pa.concat_tables(held) if len(held) > 1 else held[0]
            at, held, rows = at + take, [], 0
        if at < table.num_rows:
            held.append(table.slice(at))
            rows += table.num_rows - at
    if held:
        yield pa.concat_tables(held)


def _given(batch: pa.Table, form: str, zero_copy: bool) -> Any:
    if form == "pandas":
        frame = batch.to_pandas()
        return frame if zero_copy else frame.copy()
    if form == "numpy":
        return {name: batch.column(name).to_numpy() for name in batch.column_names}
    return batch


def as_table(value: Any, schema: pa.Schema) -> pa.Table:
    """What a function returned, in the declared columns and types."""
    if isinstance(value, pa.RecordBatch):
        value = pa.Table.from_batches([value])
    elif isinstance(value, dict):
        value = pa.table({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in value.items()})
    elif hasattr(value, "to_records") and hasattr(value, "columns"):
        value = pa.Table.from_pandas(value, preserve_index=False)
    if not isinstance(value, pa.Table):
        raise TypeError(f"a batch function returns a table, record batch, pandas frame or dict of arrays, not {type(value).__name__}")
    if missing := [name for name in schema.names if name not in value.column_names]:
        raise ValueError(f"the batch function returned no column {', '.join(missing)}")
    return value.select(schema.names).cast(schema)


def _function(config: MapConfig) -> Callable[..., Any]:
    if not isinstance(config.fn, type):
        return config.fn
    now = time.monotonic()
    for key in [k for k, used in _last_used.items() if now - used > IDLE and k != config.key]:
        del _instances[key], _last_used[key]
    if config.key not in _instances:
        _instances[config.key] = config.fn(*config.constructor_args, **dict(config.constructor_kwargs))
    _last_used[config.key] = now
    return _instances[config.key]


def mapped(config: MapConfig, tables: Iterable[pa.Table]) -> Iterator[pa.Table]:
    """Apply one map stage. The function never sees an empty batch; only real generators give several results."""
    fn = None
    for batch in rebatched(tables, config.batch_size):
        try:
            fn = fn or _function(config)
            result = fn(_given(batch, config.batch_format, config.zero_copy), *config.args, **dict(config.kwargs))
            for value in result if isinstance(result, GeneratorType) else (result,):
                table = as_table(value, config.schema)
                if table.num_rows:
                    yield table
        except Exception as e:
            if config.raise_original:
                raise
            raise BatchError(f"the batch function failed on a batch of {batch.num_rows} rows") from e


def chained(configs: tuple[MapConfig, ...], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A region: every stage rebatches what the one before it gave, all in one pass over the task's rows."""
    tables: Iterable[pa.Table] = (pa.Table.from_batches([b]) for b in batches if b.num_rows)
    for config in configs:
        tables = mapped(config, tables)
    return itertools.chain.from_iterable(t.to_batches() for t in tables)
