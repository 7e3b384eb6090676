"""Line dedup with a sharded minimal perfect hash (operator 5).

A first pass gives every distinct line of a document its 128-bit hash; grouping
by hash counts the documents that have the line and finds the smallest id among
them, its owner. The repeated lines, those of at least ``min_docs`` documents,
go into shards by hash. In a shard a minimal perfect hash (a displacement per
bucket) gives each line its own place in compact arrays: fingerprint, document
count, and the number of its owner. A second pass probes the arrays with every
line and drops a repeated line from all documents but its owner. Lines are
never joined to documents.

A line of a single document can't be dropped, so the arrays hold the repeated
lines only; a probe with any other line fails at the fingerprint.

The arrays' size is measured. The most frequent lines, as many as fit into
``max_broadcast`` bytes, are broadcast and probed where the documents are. What
is beyond that, which no broadcast could hold on a large corpus, stays in its
shards: the 128-bit hashes of the lines not yet found are sent there, in packed
blocks, and probe the arrays as a stream, so that a task holds one shard and
one block. The lines that most documents share are among the broadcast ones and
never meet in one task. Texts move only for documents that lose a line of the
second kind. Both ways give the same rows, whatever the limit.

``spare`` keeps near copies for a later step that judges whole documents: where
the lines that one owner has make at least this share of a document's text, and
of that owner's text, by bytes, the document keeps them. It loses the lines of
other owners, as the owner does.

Defined cases: lines end at LF and are compared without spaces, tabs and CR
around them; blank lines are never counted or dropped; within its owner a line
stays as often as it occurs; rows with one id count as one document each but
own a line together; a null id owns a line only if no other id has it, and a
null text stays null; very long texts are read whole; an empty table stays
empty; ids may have any type that can be ordered, other columns any name, and
all of them stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, map_rows, maybe_member, mix64, named, read, slices

#: Documents that must share a line before it counts as repeated.
MIN_DOCS = 2
LINES_PER_SHARD = 200_000
#: Largest total size of the arrays that is broadcast.
MAX_BROADCAST = 64 << 20
#: Bytes that a line takes in the arrays, with its share of the displacements.
LINE_BYTES = 32
BLANKS = b" \t\r"
KEYS_A_BUCKET = 3
#: Displacements tried for a bucket before the whole shard gets another seed.
MAX_TRIES = 1 << 20


def line_digests(text: bytes) -> list[bytes]:
    """128-bit hashes of the lines of a text as 16 bytes; empty for a blank line."""
    h = xxhash.xxh3_128_digest
    return [h(x) if x else b"" for x in (y.strip(BLANKS) for y in text.split(b"\n"))]


def _slots(key: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (mix64(key ^ (pilot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)


def build_mph(keys: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of distinct uint64 keys.

    Keys fall into buckets; from the fullest down, each bucket gets the first
    displacement that puts its keys on free places. A bucket of one key gets a
    free place directly, stored as -1 - place, so that every place is used.
    Equal keys have no perfect hash: ValueError.
    """
    n = len(keys)
    if len(np.unique(keys)) < n:
        raise ValueError("keys must be distinct")
    buckets = max(1, n // KEYS_A_BUCKET)
    at = (mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(buckets + 1))
    sizes = np.diff(starts)
    pilots = np.zeros(buckets, np.int64)
    taken = np.zeros(n, bool)
    tries = np.arange(256)
    for b in np.argsort(-sizes, kind="stable"):
        k = int(sizes[b])
        if k < 2:
            break
        own, base = keys[order[starts[b] : starts[b + 1]]], 0
        while True:
            if base >= MAX_TRIES:
                raise ValueError("no displacement fits")
            p = tries + base
            s = _slots(own[None, :], p[:, None], n)
            free = ~taken[s].any(axis=1)
            for i in np.flatnonzero(free):
                if len(set(s[i].tolist())) == k:
                    pilots[b] = p[i]
                    taken[s[i]] = True
                    break
            else:
                base += 256
                continue
            break
    free = np.flatnonzero(~taken)
    ones = np.flatnonzero(sizes == 1)
    pilots[ones] = -1 - free[: len(ones)]
    return pilots


def probe_mph(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    p = pilots[(mix64(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(len(pilots))).astype(np.int64)]
    return np.where(p < 0, -1 - p, _slots(keys, np.maximum(p, 0), n))


def shard_keys(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """64-bit keys of 128-bit hashes under a seed of their shard."""
    return mix64(h1 ^ mix64(h2 + np.uint64(seed)))


def numbered(col: F.Column, kind: T.DataType) -> F.Column:
    """64-bit number of an id: itself if it is integral, else a hash. Null is null."""
    return col.cast("long") if isinstance(kind, T.IntegralType) else F.when(col.isNotNull(), F.xxhash64(col.cast("string")))


def _number_of(docs: DataFrame, id_col: str) -> F.Column:
    return numbered(named(id_col), docs.schema[id_col].dataType)


def shared_lines(docs: DataFrame, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, docs, owner) of the lines that at least min_docs documents have.

    owner is the number of the document with the smallest id (see ``numbered``),
    null only if no document with an id has the line.
    """

    def lines(batches):
        for b in slices(batches):
            ids, texts = b.column(0), b.column(1)
            row, digest = [], []
            for i in range(len(texts)):
                v = texts[i].as_buffer()
                if v is not None:
                    own = set(line_digests(v.to_pybytes()))
                    own.discard(b"")
                    row += [i] * len(own)
                    digest += own
            h1, h2 = halves(digest)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids.take(pa.array(row, pa.int64()))], ["h1", "h2", "id"])

    base = docs.select(named(id_col).alias("id"), named(text_col).cast("binary").alias("t"))
    rows = base.mapInArrow(lines, T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), base.schema["id"]]))
    grouped = rows.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min("id").alias("first")).where(F.col("docs") >= min_docs)
    return grouped.select("h1", "h2", "docs", numbered(F.col("first"), base.schema["id"].dataType).alias("owner"))


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower 64 bits of 16-byte hashes."""
    h = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])


SHARD_SCHEMA = "shard int, n long, seed long, pilots binary, prints binary, counts binary, owners binary, sizes binary, nobody binary"


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """One row a shard, with its arrays as bytes."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        for seed in range(64):  # two lines may share a 64-bit key under one seed, not under many
            key = shard_keys(h1, h2, seed)
            try:
                pilots = build_mph(key)
                break
            except ValueError:
                continue
        else:
            raise ValueError("no perfect hash for a shard: lines must be distinct")
        place = probe_mph(key, pilots, len(key))
        arrays = [np.zeros(len(key), t) for t in (np.uint64, np.int32, np.int64, np.int64, np.bool_)]
        owner = table.column("owner").combine_chunks().take(pa.array(order))
        size = table.column("owner_size").combine_chunks().fill_null(0).to_numpy()[order]
        count = np.minimum(table.column("docs").to_numpy()[order], np.iinfo(np.int32).max)
        for a, v in zip(arrays, (h2, count, owner.fill_null(0).to_numpy(), size, owner.is_null().to_numpy(zero_copy_only=False)), strict=True):
            a[place] = v
        cells = {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in zip(("pilots", "prints", "counts", "owners", "sizes", "nobody"), [pilots, *arrays], strict=True)}
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n": pa.array([len(key)], pa.int64()), "seed": pa.array([seed], pa.int64()), **cells})

    sharded = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(build, SHARD_SCHEMA)


class Arrays:
    """Shards of the minimal perfect hash, probed with 128-bit hashes."""

    def __init__(self, rows, shards: int):
        self.count, self.shards = shards, {}
        for r in rows:
            parts = ((k, t) for k, t in (("pilots", np.int64), ("prints", np.uint64), ("counts", np.int32), ("owners", np.int64), ("sizes", np.int64), ("nobody", np.bool_)))
            self.shards[r["shard"]] = (r["n"], r["seed"], *(np.frombuffer(r[k], t) for k, t in parts))

    def probe(self, h1: np.ndarray, h2: np.ndarray, min_docs: int) -> tuple[np.ndarray, ...]:
        """(repeated, owner, bytes of the owner, has no owner) of every line; hashes are uint64."""
        n = len(h1)
        hit, owner, size, nobody = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        if not self.shards or not n:
            return hit, owner, size, nobody
        of = h1.view(np.int64) % np.int64(self.count)
        order = np.argsort(of, kind="stable")
        numbers, at = np.unique(of[order], return_index=True)
        for s, rows in zip(numbers.tolist(), np.split(order, at[1:]), strict=True):
            if s not in self.shards:
                continue
            m, seed, pilots, prints, counts, owners, sizes, none = self.shards[s]
            place = probe_mph(shard_keys(h1[rows], h2[rows], seed), pilots, m)
            hit[rows] = (prints[place] == h2[rows]) & (counts[place] >= min_docs)
            owner[rows], size[rows], nobody[rows] = owners[place], sizes[place], none[place]
        return hit, owner, size, nobody


class Lines:
    """Lines of a batch of texts that aren't blank: row, place within the text, hash, size."""

    def __init__(self, texts: pa.Array):
        self.texts, row, place, digest, size = [], [], [], [], []
        for i in range(len(texts)):
            v = texts[i].as_buffer()
            self.texts.append(None if v is None else v.to_pybytes())
            if v is None:
                continue
            for k, y in enumerate(self.texts[-1].split(b"\n")):
                x = y.strip(BLANKS)
                if x:
                    row.append(i), place.append(k), digest.append(xxhash.xxh3_128_digest(x)), size.append(len(x))
        self.row, self.place, self.size = np.array(row, np.int64), np.array(place, np.int64), np.array(size, np.int64)
        self.h1, self.h2 = halves(digest)

    def without(self, dropped: np.ndarray) -> tuple[list, np.ndarray]:
        """Texts without the dropped lines, and how many each lost."""
        lost = np.bincount(self.row[dropped], minlength=len(self.texts))
        out, first = list(self.texts), np.searchsorted(self.row, np.arange(len(self.texts) + 1))
        for i in np.flatnonzero(lost).tolist():
            gone = set(self.place[first[i] : first[i + 1]][dropped[first[i] : first[i + 1]]].tolist())
            out[i] = b"\n".join(x for k, x in enumerate(self.texts[i].split(b"\n")) if k not in gone)
        return out, lost


def spared(lines: Lines, dropped: np.ndarray, owner: np.ndarray, owner_size: np.ndarray, share: float) -> np.ndarray:
    """``dropped`` without the lines that a document shares with an owner of which it is a near copy."""
    at = np.flatnonzero(dropped)
    if not len(at):
        return dropped
    pair, back = np.unique(np.column_stack([lines.row[at], owner[at], owner_size[at]]), axis=0, return_inverse=True)
    got = np.bincount(back.ravel(), lines.size[at])
    own = np.array([len(t or b"") for t in lines.texts])
    near = got >= share * np.maximum(own[pair[:, 0]], pair[:, 2])
    out = dropped.copy()
    out[at[near[back.ravel()]]] = False
    return out


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col="doc_id", text_col="text", lost_col: str | None = None, max_broadcast: int = MAX_BROADCAST, lines_per_shard: int = LINES_PER_SHARD, spare: float | None = None) -> DataFrame:
    """``docs`` with repeated lines dropped from all but their owners; all columns stay.

    ``lost_col`` names an int column to add with the number of lines dropped;
    it must be a new name. ``spare`` leaves near copies alone, as said above.
    """
    if lost_col and lost_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {lost_col} already")
    spark = docs.sparkSession
    lines = cut(shared_lines(docs, min_docs, id_col, text_col))
    if spare is not None:
        sizes = docs.select(_number_of(docs, id_col).alias("owner"), F.octet_length(named(text_col)).cast("long").alias("size")).groupBy("owner").agg(F.max("size").alias("owner_size"))
        lines = cut(lines.join(sizes, "owner", "left"))
    else:
        lines = lines.withColumn("owner_size", F.lit(0).cast("long"))
    # from the most frequent lines on (by binary digits of their number of documents), what fits is broadcast
    digits = F.length(F.bin("docs"))
    room, bar, n_near, n_far = max_broadcast // LINE_BYTES, None, 0, 0
    for r in lines.groupBy(digits.alias("digits")).agg(F.count("*").alias("n")).orderBy(F.desc("digits")).collect():
        if n_far or n_near + r.n > room:
            n_far += r.n
        else:
            n_near, bar = n_near + r.n, r.digits
    near_shards, far_shards = -(-n_near // lines_per_shard), -(-n_far // lines_per_shard)
    near = lines.where(digits >= bar) if bar is not None else None
    blobs = [r.asDict() for r in build_shards(near, near_shards).collect()] if near_shards else []
    arrays = spark.sparkContext.broadcast((blobs, near_shards))
    work = docs.withColumn(lost_col, F.lit(None).cast("int")) if lost_col else docs
    number = fresh(work, "id_number")
    if not n_far:
        return _rewritten(work.withColumn(number, _number_of(docs, id_col)), number, None, text_col, lost_col, arrays, min_docs, spare)
    far = cut(build_shards(lines.where(digits < bar) if bar is not None else lines, far_shards))
    hits = cut(_far_hits(docs, far, far_shards, arrays, min_docs, id_col, text_col))
    keyed = work.withColumn(number, _number_of(docs, id_col))
    some = cut(hits.select("number").where("number is not null").distinct().withColumn("hash", F.xxhash64("number")))
    probe = maybe_member(spark, some, "hash")
    lists = hits.groupBy(F.col("number").alias("of")).agg(F.collect_list(F.struct("h1", "h2", "owner", "size")).alias("found"))
    found = fresh(keyed, "found")
    doubtful = keyed.where(probe(F.xxhash64(named(number))) | named(number).isNull())
    of = fresh(keyed, "of")
    joined = doubtful.join(lists.withColumnsRenamed({"found": found, "of": of}), named(number).eqNullSafe(named(of)), "left").drop(named(of))
    clear = keyed.where(~probe(F.xxhash64(named(number))) & named(number).isNotNull())
    return _rewritten(clear, number, None, text_col, lost_col, arrays, min_docs, spare).unionByName(_rewritten(joined, number, found, text_col, lost_col, arrays, min_docs, spare))


def _rewritten(keyed: DataFrame, number: str, found: str | None, text_col: str, lost_col: str | None, arrays, min_docs: int, spare: float | None) -> DataFrame:
    """Documents without the lines that others own. ``found`` has the lines that far shards know."""
    names = keyed.columns
    text_at, number_at = names.index(text_col), names.index(number)
    lost_at, found_at = (names.index(c) if c else None for c in (lost_col, found))
    keep = [i for i in range(len(names)) if i not in (number_at, found_at)]
    def run(batches):
        table = Arrays(*arrays.value)
        for b in batches:
            lines = Lines(b.column(text_at).cast(pa.binary()))
            hit, owner, size, nobody = table.probe(lines.h1, lines.h2, min_docs)
            ids = b.column(number_at)
            null = ids.is_null().to_numpy(zero_copy_only=False)[lines.row]
            mine = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[lines.row]
            dropped = hit & ~np.where(nobody, null, ~null & (owner == mine))
            if found_at is not None:
                _add_far(b.column(found_at), lines, dropped, owner, size)
            if spare is not None:
                dropped = spared(lines, dropped, owner, size, spare)
            texts, lost = lines.without(dropped)
            cols = list(b.columns)
            cols[text_at] = pa.array(texts, pa.binary()).cast(b.schema.field(text_at).type)
            if lost_at is not None:
                cols[lost_at] = pa.array(lost.astype(np.int32))
            yield pa.RecordBatch.from_arrays([cols[i] for i in keep], names=[f"c{i}" for i in keep])

    return map_rows(keyed, run, [keyed.schema.fields[i] for i in keep])


def _add_far(column: pa.Array, lines: Lines, dropped: np.ndarray, owner: np.ndarray, size: np.ndarray) -> None:
    """Marks the lines that the far shards know, with their owners."""
    for i, found in enumerate(column.to_pylist()):
        if found:
            known = {(x["h1"] & 0xFFFFFFFFFFFFFFFF, x["h2"] & 0xFFFFFFFFFFFFFFFF): x for x in found}
            a, e = np.searchsorted(lines.row, [i, i + 1])
            for k in range(a, e):
                x = known.get((int(lines.h1[k]), int(lines.h2[k])))
                if x:
                    dropped[k], owner[k], size[k] = True, x["owner"], x["size"]


ASKED = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("number", "<i8"), ("null", "?")])
FAR_HITS = "number long, h1 long, h2 long, owner long, size long"


def _far_hits(docs: DataFrame, far: DataFrame, shards: int, arrays, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(number, h1, h2, owner, size): lines to drop that are in far shards; their hashes go there in blocks."""

    def ask(batches):
        near = Arrays(*arrays.value)
        for b in slices(batches):
            lines = Lines(b.column(1))
            open_ = np.flatnonzero(~near.probe(lines.h1, lines.h2, min_docs)[0])
            asked = np.zeros(len(open_), ASKED)
            ids = b.column(0)
            asked["h1"], asked["h2"] = lines.h1[open_], lines.h2[open_]
            asked["number"] = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[lines.row[open_]]
            asked["null"] = ids.is_null().to_numpy(zero_copy_only=False)[lines.row[open_]]
            asked = np.unique(asked)
            of = (asked["h1"].view(np.int64) % np.int64(shards)).astype(np.int32)
            order = np.argsort(of, kind="stable")
            asked, of = asked[order], of[order]
            at = np.flatnonzero(np.r_[len(of) > 0, of[1:] != of[:-1]])
            offsets = (np.r_[at, len(of)] * ASKED.itemsize).astype(np.int32)
            blocks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(asked))])
            yield pa.RecordBatch.from_arrays([pa.array(of[at]), blocks], ["shard", "block"])

    def answer(batches):
        table, shard = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["block"] is None:  # a shard's arrays come before its blocks
                    table, shard = Arrays([r], shards), r["shard"]
                elif shard == r["shard"]:
                    q = np.frombuffer(r["block"], ASKED)
                    hit, owner, size, nobody = table.probe(np.ascontiguousarray(q["h1"]), np.ascontiguousarray(q["h2"]), min_docs)
                    go = hit & ~np.where(nobody, q["null"], ~q["null"] & (owner == q["number"]))
                    out.append((q[go], owner[go], size[go]))
            q = np.concatenate([x[0] for x in out]) if out else np.zeros(0, ASKED)
            rest = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(q["number"], mask=q["null"]), pa.array(q["h1"].view(np.int64)), pa.array(q["h2"].view(np.int64)), *map(pa.array, rest)], ["number", "h1", "h2", "owner", "size"])

    base = docs.select(_number_of(docs, id_col).alias("number"), named(text_col).cast("binary").alias("t"))
    asked = base.mapInArrow(ask, "shard int, block binary").select("shard", "block", *[F.lit(None).cast(f.dataType).alias(f.name) for f in far.schema.fields[1:]])
    both = far.select("shard", F.lit(None).cast("binary").alias("block"), *far.columns[1:]).unionByName(asked)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    return both.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", F.col("block").isNotNull()).mapInArrow(answer, FAR_HITS)


def op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, lost_col="lines_dropped")


OP5_SQL = f"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM p),
k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS b FROM l),
c AS (SELECT b, count(DISTINCT doc_id) AS docs, min(doc_id) AS owner FROM k WHERE b <> '' GROUP BY b HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.doc_id, k.pos, k.line, (c.b IS NOT NULL AND c.owner <> k.doc_id) AS d FROM k LEFT JOIN c ON k.b = c.b),
g AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT d), '') AS text, CAST(count(*) FILTER (WHERE d) AS INTEGER) AS lines_dropped FROM m GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE g.text END AS text, coalesce(g.lines_dropped, 0) AS lines_dropped FROM documents t LEFT JOIN g ON t.doc_id = g.doc_id
"""
