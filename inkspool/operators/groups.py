"""Whole groups of rows to a Python function, many groups per call.

``map_groups`` shuffles once by the keys, sorts within partitions, and hands
over Arrow tables that hold whole groups only. One call serves all groups of a
batch, which costs far less than one call a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def group_bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a group starts, and the number of rows."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        c = table.column(k).combine_chunks()
        v = (c.dictionary_encode().indices if pa.types.is_string(c.type) else c).fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.r_[np.flatnonzero(new), len(table)]


def runs_of_groups(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first group, last one + 1) of runs of up to ``most`` rows; a larger group is a run of its own."""
    a, n = 0, len(bounds) - 1
    while a < n:
        e = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1)
        yield a, e
        a = e


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, most: int = 1 << 13) -> DataFrame:
    """``fn(table, bounds)`` on tables of whole groups, sorted by keys and order; up to ``most`` rows a call, or one larger group."""
    keys = list(keys)

    def whole(t: pa.Table, bounds: np.ndarray):
        for a, e in runs_of_groups(bounds, most):
            yield from fn(t.slice(int(bounds[a]), int(bounds[e] - bounds[a])), bounds[a : e + 1] - bounds[a]).to_batches()

    def run(batches):
        held: list[pa.Table] = []  # parts of one group
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            if held and len(group_bounds(pa.concat_tables([held[-1].slice(len(held[-1]) - 1), t]), keys)) == 2:
                held.append(t)
                continue
            t = pa.concat_tables([*held, t]).combine_chunks()
            bounds = group_bounds(t, keys)
            done = int(bounds[-2])
            yield from whole(t.slice(0, done), bounds[:-1])
            held = [t.slice(done)]
        if held:
            t = pa.concat_tables(held).combine_chunks()
            yield from whole(t, np.array([0, len(t)]))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
