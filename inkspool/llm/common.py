"""Helpers shared by the training-data operators.

Text enters Python as Arrow batches; the functions here expose a string column
as one byte array with offsets, so that the operators work on whole batches
with numpy and never loop over characters.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a numpy kernel works on at a time.
CHUNK_BYTES = 1 << 18

#: Largest bitmap (in bits) that a probe filter broadcasts: 2^27 bits are 16 MB.
#: Beyond it the filter lets more rows through to the exact join; it never drops any.
MAX_FILTER_BITS = 1 << 27


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints that all machines share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where there is none and the master is local (tests), a temporary
    folder is made; on a cluster that would be each machine's own disk.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ink-cp-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hash60(col) -> F.Column:
    """60-bit hash of a value's decimal string, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(col.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(col) -> F.Column:
    """Number of maximal runs of characters other than space, tab, CR, LF and FF; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[lo:hi], offsets - lo


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document comes alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def member_bitmap(keys: DataFrame, hash_col: str) -> tuple[np.ndarray, int]:
    """Bitmap with the bit ``hash mod m`` set for every 64-bit hash of ``keys``.

    m is the power of two next to 16 bits a key, at most MAX_FILTER_BITS. The
    bits are gathered as 64-bit words that executors have or-ed together, so
    the driver gets at most m / 64 of them, whatever the number of keys.
    """
    n = keys.count()
    m = min(MAX_FILTER_BITS, 1 << max(10, (16 * n).bit_length()))
    slot = F.col(hash_col).bitwiseAND(F.lit(m - 1))
    words = (
        keys.select(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
        .toArrow()
    )
    bitmap = np.zeros(m // 64, np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return bitmap, m


def maybe_member(spark: SparkSession, keys: DataFrame, hash_col: str):
    """Column function: may the hash be among ``keys``? No false negatives.

    Only the hash crosses to Python; the other columns wait in the JVM.
    """

    bitmap, m = member_bitmap(keys, hash_col)
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        x = h.to_numpy(np.int64) & np.int64(m - 1)
        return pd.Series((shared.value[x >> 6] >> (x & 63)) & 1 == 1)

    return probe


def named(column: str) -> F.Column:
    """A column of just that name, also one with dots or backticks in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that copies of their texts stay small."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)


def map_rows(df: DataFrame, run, fields: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` over all columns, whatever they are called; ``fields`` are those of the result, in order."""
    plain = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(fields)]

    def renamed(batches):
        for b in run(slices(batches)):
            yield b.rename_columns([f.name for f in plain])

    out = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, T.StructType(plain))
    return out.toDF(*[f.name for f in fields])


def with_id(base: DataFrame, rest: str) -> T.StructType:
    """Schema of a result: the first column of ``base`` as it is, then the fields of ``rest``."""
    return T.StructType([base.schema.fields[0], *T.StructType.fromDDL(rest).fields])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer where a column of ``df`` is called so already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``ids`` (its only column); null ids stay.

    Most rows are passed by a bitmap without moving; only those that it can't
    clear are shuffled to an exact anti join. So texts of kept rows don't move.
    """
    key = fresh(df, "dropped_id")
    keys = ids.toDF(key).where(named(key).isNotNull()).distinct()
    keys = cut(keys.withColumn("hash", F.xxhash64(named(key))))
    probe = maybe_member(df.sparkSession, keys, "hash")
    probed = probe(F.xxhash64(named(id_col)))
    clear = df.where(~probed)
    doubtful = df.where(probed).join(keys.select(named(key)), named(id_col) == named(key), "left_anti")
    return clear.unionByName(doubtful)
