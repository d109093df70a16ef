"""Rebatching and calling user functions, without Spark."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from batchloom.operators.worker import BatchError, MapConfig, chained, rebatched

X = pa.schema([("x", pa.int64())])


def table(values):
    return pa.table({"x": pa.array(values, pa.int64())})


def batches(*parts):
    return [b for p in parts for b in (table(p).to_batches() or [pa.RecordBatch.from_pylist([], schema=X)])]


def run(configs, *parts):
    return [v for b in chained(tuple(configs), batches(*parts)) for v in b.column("x").to_pylist()]


def config(fn, size=2, form="pyarrow", **kwargs):
    return MapConfig(fn, size, form, kwargs.pop("schema", X), kwargs.pop("key", ("test", 0)), **kwargs)


@given(st.lists(st.integers(0, 9), max_size=8), st.integers(1, 7))
def test_rebatching(sizes, size):
    parts, at = [], 0
    for n in sizes:
        parts.append(table(range(at, at + n)))
        at += n
    got = list(rebatched(parts, size))
    assert [v for t in got for v in t.column("x").to_pylist()] == list(range(at))
    assert all(t.num_rows == size for t in got[:-1])
    assert not got or 0 < got[-1].num_rows <= size


def test_each_stage_rebatches():
    seen = {1: [], 2: []}

    def note(b, k):
        seen[k].append(b.num_rows)
        return b

    assert run([config(note, 4, args=(1,)), config(note, 3, args=(2,))], range(5), [], range(5)) == [*range(5), *range(5)]
    assert seen == {1: [4, 4, 2], 2: [3, 3, 3, 1]}


def test_only_real_generators_give_several_results():
    def halves(b):
        yield b.slice(0, 1)
        yield b.slice(1)

    assert run([config(halves)], [1, 2, 3]) == [1, 2, 3]
    with pytest.raises(BatchError) as e:
        run([config(lambda b: iter([b]))], [1])
    assert isinstance(e.value.__cause__, TypeError)


def test_empty_batches_are_not_seen():
    calls = []
    second = config(lambda b: calls.append(b) or b, key=("test", 1))
    assert run([config(lambda b: b.slice(0, 0)), second], [1, 2]) == []
    assert run([second], []) == []
    assert calls == []


def test_classes_are_made_once():
    class Counted:
        made = 0

        def __init__(self, add, twice=False):
            Counted.made += 1
            self.add = add * (1 + twice)

        def __call__(self, b, more=0):
            return {"x": [v + self.add + more for v in b.column("x").to_pylist()]}

    c = config(Counted, key=("once", 0), constructor_args=(1,), constructor_kwargs=(("twice", True),), kwargs=(("more", 10),))
    assert run([c], [1, 2, 3]) == [13, 14, 15]
    assert run([c], [1]) == [13]
    assert Counted.made == 1


@pytest.mark.parametrize("give", [lambda b: b, lambda b: b.to_batches()[0], lambda b: b.to_pandas(), lambda b: {"x": b.column("x").to_numpy()}, lambda b: {"extra": b.column("x"), "x": b.column("x")}])
def test_what_functions_may_return(give):
    assert run([config(give)], [1, 2, 3]) == [1, 2, 3]


def test_formats_and_nulls():
    assert run([config(lambda f: f.assign(x=f.x + 1), form="pandas")], [1, 2]) == [2, 3]
    assert run([config(lambda d: {"x": d["x"] * 2}, form="numpy")], [1, 2]) == [2, 4]
    assert run([config(lambda b: b)], [None, 2]) == [None, 2]

    def change(frame: pd.DataFrame):
        frame["x"] = 0
        return frame

    assert run([config(change, form="pandas", zero_copy=True)], [1]) == [0]


def test_errors():
    def bad(b):
        raise KeyError("inner")

    with pytest.raises(BatchError) as e:
        run([config(bad)], [1])
    assert isinstance(e.value.__cause__, KeyError)
    with pytest.raises(KeyError):
        run([config(bad, raise_original=True)], [1])
    with pytest.raises(BatchError) as e:
        run([config(lambda b: {"y": [1]})], [1])
    assert "no column x" in str(e.value.__cause__)
