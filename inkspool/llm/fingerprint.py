"""Homomorphic multiset fingerprints of documents (operator 10).

Each paragraph is hashed with SHAKE-128 to ``LANES`` numbers of 16 bits; a
document's state is their sum over its paragraphs modulo 2^16, lane by lane.
Sums commute, so documents with the same multiset of paragraphs have the same
state in any order; adding or subtracting a paragraph's vector inserts or
deletes it; and states of documents add up to that of any union of them.

Defined cases: paragraphs end at LF and are taken without white space around
them, blank ones don't count; a text without paragraphs has the zero state; a
null text has a null state; a paragraph counts as often as it occurs; rows with
one id get one result each; very long texts are read whole; an empty table
gives an empty result; ids may have any type, other columns any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named, read, with_id

#: Lanes of 16 bits. The state has 2 bytes a lane.
LANES = 256


def paragraphs(text: bytes) -> list[bytes]:
    return [p for p in (x.strip() for x in text.split(b"\n")) if p]


def state(parts: list[bytes], lanes: int = LANES) -> np.ndarray:
    if not parts:
        return np.zeros(lanes, np.uint16)
    raw = b"".join(hashlib.shake_128(p).digest(2 * lanes) for p in parts)
    return np.frombuffer(raw, "<u2").reshape(-1, lanes).sum(axis=0, dtype=np.uint64).astype(np.uint16)


def insert(s: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """State after inserting paragraphs."""
    return s + state(parts, len(s))


def delete(s: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """State after deleting paragraphs that are in it."""
    return s - state(parts, len(s))


def fingerprints(docs: DataFrame, lanes: int = LANES, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, paragraphs, state, digest): no shuffle; digest is the SHA-256 of the state."""

    def run(batches):
        for b in batches:
            count, states, digests = [], [], []
            for v in b.column(1):
                raw = v.as_buffer()
                if raw is None:
                    count.append(None), states.append(None), digests.append(None)
                    continue
                parts = paragraphs(raw.to_pybytes())
                s = state(parts, lanes).astype("<u2").tobytes()
                count.append(len(parts)), states.append(s), digests.append(hashlib.sha256(s).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(states, pa.binary()), pa.array(digests, pa.string())], ["doc_id", "paragraphs", "state", "digest"])

    base = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("binary").alias("t"))
    return base.mapInArrow(run, with_id(base, "paragraphs long, state binary, digest string"))


def combine(prints: DataFrame, by: str, lanes: int = LANES) -> DataFrame:
    """(by, state): sum of the states of each group; partitions are summed before the shuffle."""

    def partial(batches):
        sums: dict = {}
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s is not None:
                    sums[k] = sums.get(k, np.zeros(lanes, np.uint16)) + np.frombuffer(s, "<u2")
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([sums[k].astype("<u2").tobytes() for k in keys], pa.binary())], ["k", "state"])

    def final(table: pa.Table) -> pa.Table:
        s = np.zeros(lanes, np.uint16)
        for x in table.column("state").to_pylist():
            s = s + np.frombuffer(x, "<u2")
        return pa.table({by: table.column("k").slice(0, 1), "state": pa.array([s.astype("<u2").tobytes()], pa.binary())})

    parts = prints.select(named(by).cast("string").alias("k"), "state").mapInArrow(partial, "k string, state binary")
    return parts.groupBy("k").applyInArrow(final, f"`{by}` string, state binary")


def op10(spark, sf_dir):
    return fingerprints(read(spark, sf_dir, "documents"))
