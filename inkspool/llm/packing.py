"""Best-fit-decreasing packing of documents into token windows (operator 4).

A document longer than a window is first cut into full windows; its remainder
and all shorter documents are packed, longest first, each into the open window
with the least remaining capacity that still holds it. A segment tree over the
capacities 0 .. size finds that window in log2(size) steps.

Documents are spread by a hash of their id over shards of about
``docs_per_shard`` documents, which are packed on their own; a shard wastes at
most its last windows. Only ids and lengths move, never texts; a segment names
its document, its first token and its number of tokens.

Defined cases: null and empty texts have no tokens and no segment; rows with
one id are packed once each; a null id is packed as null. Equal lengths are
taken by id, then by first token; very long texts are cut into as many windows
as they fill; an empty table gives an empty result; ids may have any type that
can be ordered, other columns any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, read, word_count

#: Tokens in a window.
WINDOW = 2048
DOCS_PER_SHARD = 40_000

SCHEMA = "window_id string, slot int, doc_id long, start_token long, n_tokens long"


class CapacityTree:
    """Open windows by remaining capacity; ``take(n)`` gives the tightest that holds n tokens."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) with the least capacity of at least ``need``; of equals the latest. Removes it."""
        count, i = self.count, self.leaves + need
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right neighbour holds something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        window = self.windows[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, window


def best_fit_decreasing(lengths: list[int], size: int) -> list[int]:
    """Window number of every piece; ``lengths`` are descending and at most ``size``."""
    tree, out, n = CapacityTree(size), [], 0
    for need in lengths:
        found = tree.take(need)
        if found is None:
            capacity, window = size, n
            n += 1
        else:
            capacity, window = found
        out.append(window)
        if capacity > need:
            tree.add(capacity - need, window)
    return out


def pack_shard(ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(window, slot, row, start, tokens) of the segments of one shard."""
    full = lengths // size
    rows = np.repeat(np.arange(len(ids)), full)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
    rest = np.flatnonzero(lengths % size)
    n = (lengths % size)[rest]
    order = np.lexsort((full[rest], ids[rest], ~valid[rest], -n))
    rest, n = rest[order], n[order]
    window = np.array(best_fit_decreasing(n.tolist(), size), np.int64)
    by = np.argsort(window, kind="stable")
    ws = window[by]
    first = np.r_[True, ws[1:] != ws[:-1]] if len(ws) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    slot = np.arange(len(ws)) - np.repeat(at, np.diff(np.r_[at, len(ws)]))
    rest, n = rest[by], n[by]
    return (
        np.r_[np.arange(len(rows)), ws + len(rows)],
        np.r_[np.zeros(len(rows), np.int64), slot],
        np.r_[rows, rest],
        np.r_[nth * size, full[rest] * size],
        np.r_[np.full(len(rows), size, np.int64), n],
    )


def pack(docs: DataFrame, size: int = WINDOW, docs_per_shard: int = DOCS_PER_SHARD, id_col="doc_id", text_col="text", tokens=word_count) -> DataFrame:
    """One row a segment: (window_id, slot, doc_id, start_token, n_tokens)."""
    shards = max(1, -(-docs.count() // docs_per_shard))
    narrow = docs.select(
        named(id_col).alias("id"),
        tokens(named(text_col)).alias("n"),
        F.pmod(F.xxhash64(named(id_col)), F.lit(shards)).cast("int").alias("shard"),
    ).where("n > 0")

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("n", "ascending")])
        ids = table.column("id").combine_chunks()
        place = ids.dictionary_encode().indices  # ids are sorted: their number in order of appearance is their rank
        valid = place.is_valid().to_numpy(zero_copy_only=False)
        w, slot, row, start, n = pack_shard(place.fill_null(0).to_numpy(zero_copy_only=False), valid, table.column("n").to_numpy(), size)
        name = f"{table.column('shard')[0].as_py()}-"
        return pa.table({"window_id": pa.array([f"{name}{x}" for x in w.tolist()], pa.string()), "slot": pa.array(slot, pa.int32()), "doc_id": ids.take(pa.array(row)), "start_token": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    return narrow.groupBy("shard").applyInArrow(shard, T.StructType([T.StructField(f.name, narrow.schema["id"].dataType if f.name == "doc_id" else f.dataType) for f in T.StructType.fromDDL(SCHEMA)]))


def op4(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))
