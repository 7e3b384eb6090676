"""SimHash near-dedup with a Gray-order hierarchical index (operator 6).

Fingerprint: each distinct lower-cased word of a text votes on 256 bits. Texts
are near duplicates if their fingerprints differ in at most ``MAX_BITS`` bits;
groups are the connected components, and the smallest id of each stays.

Search: equal fingerprints are collapsed first, whatever their number. Then
every fingerprint enters ``TABLES`` tables: each of ``PERMUTATIONS`` fixed
permutations of the bits is cut into keys of ``KEY_BITS``, and fingerprints
that agree on a key form a bucket of its table, which is whole in one
partition of the search. Keys and tables don't depend
on the corpus, so which pairs are compared doesn't change when others come,
and what is shuffled grows in proportion to the number of documents.

A bucket is searched without loss. Its fingerprints are sorted by Gray rank;
runs of them that share many bits become nodes, which store these bits as mask
and pattern. A query adds its differences under a node's mask to those so far
(none under the key) and leaves the whole node as soon as they exceed the
limit; where even the bits that differ inside the node can't reach the limit,
it takes the node as a whole; else it goes on to the rows. In a large bucket a
few of its rows first gather all that are near them. What is connected that
way needs no further comparison inside, so thousands of copies that differ
cost one pass each. Every fingerprint is a query.

A bucket of more than ``LEAF`` rows that this leaves unconnected is cut again
by ``VIEWS`` further keys of ``VIEW_BITS``, which keep 0.99 of the pairs at the
limit and more of the closer ones. Below that, which takes some 100 million
documents to pass, what shares a key and is near is always found.

Groups come from large-star / small-star rounds over the found edges, so that
chains and groups of thousands close in a few rounds.

Defined cases: a null text, and one without a word, is in no group but its own;
rows with one id are one document and stay or go together; rows with a null id
are in no group and stay; of equal fingerprints the smallest id leads; very
long texts are read whole, in pieces; an empty table gives an empty result;
ids may have any type that can be ordered, and other columns any name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, cut, doc_chunks, drop_ids, mix64, named, read, slices, text_bytes

BITS, WORDS = 256, 4
#: Fingerprints that differ in at most this many of 256 bits are near duplicates.
MAX_BITS = 44
#: Fixed layout: each permutation gives 18 keys of 14 bits (4 bits are over); for its recall by distance see the README.
KEY_BITS, PERMUTATIONS = 14, 3
TABLES = PERMUTATIONS * (BITS // KEY_BITS)
#: Bits that the rows of a node of more than two share, more than twice MAX_BITS, so that unrelated queries leave it.
SHARED = 112
#: Rows from which a bucket is searched on its own.
LARGE = 256
#: Rows from which a bucket is cut by further keys.
LEAF, VIEW_BITS, VIEWS = 1 << 15, 12, 44
LEADERS = 32
PAIRS_AT_ONCE = 1 << 18
#: Largest size aimed at for a partition of the search, of which each table has as many as it needs.
PART_BYTES = 48 << 20
SEED = 20240229

_WORD = np.zeros(256, bool)
for _r in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[slice(*_r)] = True
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_BASE = 0x9FB21C651E98DF25


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, for words anywhere in a chunk."""
    n = 2 * CHUNK_BYTES + 1
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word of a chunk; words end at document starts."""
    w = _WORD[data]
    first, last = w.copy(), w.copy()
    cut_ = np.zeros(len(w) + 1, bool)
    cut_[starts] = True
    first[1:] &= ~w[:-1] | cut_[1:-1]
    last[:-1] &= ~w[1:] | cut_[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return a, mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


#: A byte as its 8 bits, highest first, in the 8 bytes of one word: sums of words count 8 bits at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _votes(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (docs x 4 uint64) of distinct words, and which documents have words."""
    low = np.uint64((1 << 44) - 1)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h & low))
    key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
    doc, h = (key >> np.uint64(44)).astype(np.int64), key & low
    prints, has = np.zeros((docs, WORDS), np.uint64), np.zeros(docs, bool)
    if not len(key):
        return prints, has
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[at, len(doc)])
    has[doc[at]] = True
    runs = -(-size // 255)  # up to 255 words are counted in bytes
    first = np.cumsum(runs) - runs
    run_at = np.repeat(at, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
    for k in range(WORDS):
        bits = _SPREAD[mix64(h + _LANES[k]).view(np.uint8).reshape(-1, 8)]
        counts = np.add.reduceat(bits, run_at, axis=0).view(np.uint8).reshape(len(run_at), 64)
        ones = counts.astype(np.int32) if len(run_at) == len(at) else np.add.reduceat(counts, first, axis=0, dtype=np.int32)
        prints[doc[at], k] = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64).ravel()
    return prints, has


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of lower-cased texts, and which of them have words."""
    n = len(offsets) - 1
    prints, has = np.zeros((n, WORDS), np.uint64), np.zeros(n, bool)
    for i, j in doc_chunks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * CHUNK_BYTES:
            starts = offsets[i:j] - lo
            a, h = word_hashes(data[lo:hi], starts)
            prints[i:j], has[i:j] = _votes(np.searchsorted(starts, a, side="right") - 1, h, j - i)
            continue
        parts, p = [], lo  # one very long text: pieces that end between words
        while p < hi:
            e = min(hi, p + CHUNK_BYTES)
            if e < hi:
                gap = np.flatnonzero(~_WORD[data[p:e]])
                e = p + int(gap[-1]) + 1 if len(gap) else e
            parts.append(np.unique(word_hashes(data[p:e], np.zeros(1, np.int64))[1] & np.uint64((1 << 44) - 1)))
            p = e
        h = np.unique(np.concatenate(parts))
        prints[i:j], has[i:j] = _votes(np.zeros(len(h), np.int64), h, 1)
    return prints, has


PRINTS = [f"f{k}" for k in range(WORDS)]


def fingerprint_table(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, f0..f3) of the documents that have an id and a word."""

    def run(batches):
        for b in slices(batches):
            fp, has = fingerprints(*text_bytes(b.column(1)))
            mask = pa.array(has)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), *[pa.array(fp[has, k].view(np.int64)) for k in range(WORDS)]], ["id", *PRINTS])

    base = docs.where(named(id_col).isNotNull()).select(named(id_col).alias("id"), F.lower(named(text_col)).alias("t"))
    return base.mapInArrow(run, T.StructType([base.schema["id"], *[T.StructField(p, T.LongType()) for p in PRINTS]]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each uint64 in the Gray sequence."""
    x = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32)


def labels(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes."""
    label = np.arange(n)
    while len(src):
        a, b = label[src], label[dst]
        apart = a != b
        if not apart.any():
            break
        src, dst, a, b = src[apart], dst[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


class GrayIndex:
    """Nodes over the fingerprints of many buckets, given sorted by (bucket, Gray rank).

    Of 64, 8 or 2 rows that follow each other in a bucket, those become one
    node that share SHARED bits; two rows always do. ``mask`` and ``value`` are
    the bits that all rows of a node share, ``free`` is the number of the rest.
    """

    def __init__(self, prints: np.ndarray, bucket: np.ndarray):
        self.prints = prints
        n = len(prints)
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        pos = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        first, mask, value, open_ = [], [], [], np.ones(n, bool)
        for fan in (64, 8, 2):
            a = np.flatnonzero(new | (pos % fan == 0))
            same = np.bitwise_and.reduceat(prints, a, axis=0)
            m = same | np.bitwise_and.reduceat(~prints, a, axis=0)
            size = np.diff(np.r_[a, n])
            take = open_[a] & ((popcount(m) >= SHARED) | (fan == 2)) & ((size > 1) | (fan == 2))
            open_ &= ~np.repeat(take, size)
            first.append(a[take]), mask.append(m[take]), value.append(same[take])
        first = np.concatenate(first)
        order = np.argsort(first)
        self.first, self.mask, self.value = first[order], np.concatenate(mask)[order], np.concatenate(value)[order]
        self.end = np.r_[self.first[1:], n]
        self.free = BITS - popcount(self.mask)
        self.own = np.repeat(np.arange(len(self.first)), self.end - self.first)
        ends = np.r_[np.flatnonzero(new)[1:], n]
        self.last = np.searchsorted(self.first, ends)[np.cumsum(new) - 1]
        self.asked = self.left = self.whole = 0

    def inside(self, limit: int):
        """Edges (i, j) within nodes."""
        for k in np.flatnonzero(self.end - self.first > 2).tolist():
            a, e = int(self.first[k]), int(self.end[k])
            if self.free[k] > limit:
                i, j = np.nonzero(np.triu(distances(self.prints[a:e], self.prints[a:e]) <= limit, 1))
                yield a + i, a + j
            else:
                yield np.full(e - a - 1, a), np.arange(a + 1, e)
        two = self.first[(self.end - self.first == 2) & (self.free <= limit)]
        yield two, two + 1

    def edges(self, limit: int):
        """Yields (i, j) arrays of rows of one bucket that are near: all such pairs, or a pair of each node taken whole."""
        yield from self.inside(limit)
        count = self.last - self.own - 1
        run, i, n = np.cumsum(count), 0, len(self.prints)
        while i < n:
            j = max(i + 1, int(np.searchsorted(run, (run[i - 1] if i else 0) + PAIRS_AT_ONCE, side="right")))
            c = count[i:j]
            rows = np.repeat(np.arange(i, j), c)
            nodes = np.repeat(self.own[i:j] + 1, c) + np.arange(len(rows)) - np.repeat(np.cumsum(c) - c, c)
            diff = np.zeros(len(rows), np.uint8)
            for w in range(WORDS):
                diff += np.bitwise_count((self.prints[:, w][rows] ^ self.value[:, w][nodes]) & self.mask[:, w][nodes])
            self.asked += len(rows)
            yield from self.below(rows, nodes, diff, limit)
            i = j

    def below(self, rows, nodes, diff, limit: int):
        """Edges of queries with the rows of nodes, from the differences under the nodes' masks."""
        keep = diff <= limit
        self.left += len(keep) - int(keep.sum())
        rows, nodes, diff = rows[keep], nodes[keep], diff[keep].astype(np.int32)
        whole = diff + self.free[nodes] <= limit
        self.whole += int(whole.sum())
        yield rows[whole], self.first[nodes[whole]]
        rows, nodes, diff = rows[~whole], nodes[~whole], diff[~whole]
        width = self.end[nodes] - self.first[nodes]
        r, k, d = (np.repeat(x, width) for x in (rows, nodes, diff))
        c = self.first[k] + np.arange(len(r)) - np.repeat(np.cumsum(width) - width, width)
        ok = d + popcount((self.prints[r] ^ self.prints[c]) & ~self.mask[k]) <= limit
        yield r[ok], c[ok]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every row of a and every row of b."""
    out = np.bitwise_count(a[:, 0, None] ^ b[None, :, 0]).astype(np.uint16)
    for w in range(1, WORDS):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def gathered(prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from a few leaders to all rows near them, as long as leaders gather many; leaders are spread over the Gray order."""
    alone, src, dst = np.ones(len(prints), bool), [], []
    while True:
        rest = np.flatnonzero(alone)
        if len(rest) < 2 * LEADERS:
            break
        lead = rest[np.linspace(0, len(rest) - 1, LEADERS).astype(np.int64)]
        i, j = np.nonzero(distances(prints[lead], prints) <= limit)
        other = lead[i] != j
        src.append(lead[i[other]]), dst.append(j[other])
        alone[src[-1]] = alone[dst[-1]] = False
        if len(rest) - alone.sum() < max(LEADERS, len(rest) // 64):
            break
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def large_bucket(prints: np.ndarray, limit: int, cut_again: bool = True) -> np.ndarray:
    """Component of each row of one bucket, given in Gray order."""
    n = len(prints)
    src, dst = gathered(prints, limit)
    label = labels(n, src, dst)
    size = np.bincount(label, minlength=n)
    group = np.where(size[label] > 1, label, -1)  # rows of one group are connected: only pairs of others are compared
    if cut_again and (group == -1).sum() + len(np.unique(group)) > LEAF:
        edges = [(src, dst), *views(prints, limit)]
        return labels(n, *(np.concatenate([e[k] for e in edges]) for k in (0, 1)))
    order = np.argsort(group, kind="stable")
    p, g = prints[order], group[order]
    index, found = GrayIndex(p, g), [(src, dst)]
    lone = int(np.searchsorted(g, 0))
    found += [(order[i], order[j]) for i, j in GrayIndex(p[:lone], g[:lone]).inside(limit)] if lone else []
    head = g[index.first]
    step = max(1, PAIRS_AT_ONCE // max(1, len(index.first)))
    step = max(step, 16)
    for i in range(0, n, step):
        rows, k = np.arange(i, min(n, i + step)), int(index.own[i])
        if g[i] >= 0:  # nodes of the same group are passed over, where all rows here belong to it
            k = int(np.searchsorted(head, g[i], side="right")) if g[rows[-1]] == g[i] else k
        for a in range(k, len(head), max(1, PAIRS_AT_ONCE // len(rows))):
            at = slice(a, a + max(1, PAIRS_AT_ONCE // len(rows)))
            diff = np.zeros((len(rows), len(head[at])), np.uint8)
            for w in range(WORDS):
                diff += np.bitwise_count((p[rows, w, None] ^ index.value[None, at, w]) & index.mask[None, at, w])
            r, c = np.nonzero(diff <= limit)
            r, c, d = rows[r], a + c, diff[r, c]
            new = (index.own[r] < c) & ((g[r] < 0) | (g[r] != head[c]))
            found += [(order[x], order[y]) for x, y in index.below(r[new], c[new], d[new], limit)]
    return labels(n, *(np.concatenate([e[k] for e in found]) for k in (0, 1)))


def views(prints: np.ndarray, limit: int):
    """Edges within the groups of rows that agree on one of VIEWS further keys."""
    rng = np.random.default_rng(SEED + 1)
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)
    for _ in range(VIEWS):
        key = bits[:, rng.choice(BITS, VIEW_BITS, replace=False)] @ (1 << np.arange(VIEW_BITS))
        order = np.lexsort((gray_rank(prints[:, 0]), key))
        for i, j in bucket_edges(prints[order], key[order], limit, cut_again=False):
            yield order[i], order[j]


def bucket_edges(prints: np.ndarray, key: np.ndarray, limit: int, cut_again: bool = True):
    """Yields (i, j) arrays that connect what is near within each bucket; rows are sorted by (key, Gray rank)."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[at, len(key)])
    each = np.repeat(size, size)
    rows = np.flatnonzero((each > 1) & (each < LARGE))
    if len(rows):
        for i, j in GrayIndex(prints[rows], key[rows]).edges(limit):
            yield rows[i], rows[j]
    for k in np.flatnonzero(size >= LARGE).tolist():
        a, e = int(at[k]), int(at[k] + size[k])
        yield a + large_bucket(prints[a:e], limit, cut_again), np.arange(a, e)


ENTRY = np.dtype([("key", "<u4"), ("id", "<i8"), ("f", "<u8", WORDS)])


@lru_cache(1)
def permutations() -> list[np.ndarray]:
    rng = np.random.default_rng(SEED)
    return [rng.permutation(BITS) for _ in range(PERMUTATIONS)]


def table_keys(prints: np.ndarray) -> np.ndarray:
    """Key of each fingerprint in each table, with the table's number in the upper 16 bits: n x TABLES."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)
    keys = np.empty((len(prints), TABLES), np.uint32)
    for t, p in enumerate(np.concatenate([p[: BITS // KEY_BITS * KEY_BITS] for p in permutations()]).reshape(TABLES, KEY_BITS)):
        two = np.packbits(bits[:, p], axis=1).astype(np.uint32)
        keys[:, t] = (t << 16) | two[:, 0] << 8 | two[:, 1]
    return keys


def spread_entries(ids: np.ndarray, prints: np.ndarray, parts: int) -> tuple[pa.Array, pa.Array]:
    """(part, entries as bytes): what each of a table's ``parts`` partitions gets of these fingerprints."""
    key = table_keys(prints).ravel()
    part = ((key >> 16).astype(np.int64) * parts + (mix64(key.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    entry = np.empty(len(key), ENTRY)
    entry["key"], entry["id"], entry["f"] = key[order], ids[order // TABLES], prints[order // TABLES]
    part = part[order]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    offsets = (np.r_[at, len(part)] * ENTRY.itemsize).astype(np.int32)
    return pa.array(part[at]), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(entry)])


def entry_edges(entry: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ids that connect what is near within each bucket; all entries of a key are here."""
    key, f = entry["key"], entry["f"]
    rank = gray_rank(f[np.arange(len(f)), (key >> 16) % WORDS])
    order = np.lexsort((rank, key))
    ids = entry["id"][order]
    found = [(ids[:0], ids[:0]), *bucket_edges(np.ascontiguousarray(f[order]), key[order], limit)]
    label = labels(len(ids), *(np.concatenate([e[k] for e in found]) for k in (0, 1)))
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[moved]], ids[moved]


def near_edges(distinct: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between the numbers (id, long) of distinct fingerprints, which connect all that are found near."""
    parts = max(1, -(-distinct.count() * ENTRY.itemsize // PART_BYTES))

    def spread(batches):
        for b in slices(batches, 4096):
            fp = np.ascontiguousarray(np.column_stack([b.column(p).to_numpy() for p in PRINTS]).view(np.uint64))
            yield pa.RecordBatch.from_arrays(list(spread_entries(b.column("id").to_numpy(), fp, parts)), ["part", "entries"])

    def search(batches):
        blobs = [v.as_buffer() for b in batches for v in b.column(1)]
        if blobs:
            a, b = entry_edges(np.frombuffer(b"".join(blobs), ENTRY), limit)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    spread_out = distinct.select("id", *PRINTS).mapInArrow(spread, "part int, entries binary")
    return spread_out.repartitionById(TABLES * parts, F.col("part")).mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of the connected component of every id that has an edge."""
    both = edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    current, size = cut(both), None
    while True:
        # large star: larger neighbours go to the smallest of the neighbourhood
        sym = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = cut(small)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == size:
            return current.select(F.col("u").alias("id"), F.col("v").alias("root"))
        size = state


def near_groups(docs: DataFrame, limit: int = MAX_BITS, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, root) of documents in groups of two or more that aren't the smallest of theirs."""
    prints = cut(fingerprint_table(docs, id_col, text_col))
    # one number for each distinct fingerprint: fixed by the checkpoint, whatever the type of the ids
    distinct = cut(prints.groupBy(*PRINTS).agg(F.min("id").alias("lead"), F.max("id").alias("top")).withColumn("id", F.monotonically_increasing_id()))
    copies = cut(prints.join(distinct.where("lead <> top").select(*PRINTS, "lead", F.col("id").alias("number")), PRINTS).where("id <> lead").select("id", "lead", "number"))
    # rows with one id and several fingerprints: these are one document
    several = prints.groupBy(F.col("id").alias("twice")).agg(F.count("*").alias("n")).where("n > 1").select("twice")
    again = prints.join(several, F.col("id") == F.col("twice")).join(distinct.select(*PRINTS, F.col("id").alias("number")), PRINTS)
    tied = again.groupBy("twice").agg(F.min("number").alias("a"), F.collect_set("number").alias("all")).select("a", F.explode("all").alias("b")).where("a <> b")
    roots = components(near_edges(distinct, limit).unionByName(tied))
    member = cut(roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct()).join(distinct.select("id", "lead"), "id"))
    best = member.groupBy("root").agg(F.min("lead").alias("best"))
    moved = cut(member.join(best, "root").select("id", "lead", "best"))
    by_copy = copies.join(moved.select(F.col("id").alias("number"), "best"), "number", "left").select("id", F.coalesce("best", "lead").alias("root"))
    return moved.select(F.col("lead").alias("id"), F.col("best").alias("root")).unionByName(by_copy).where("id <> root").distinct()


def op6_groups(docs: DataFrame, limit: int = MAX_BITS, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, group_id, keep) of all documents."""
    roots = near_groups(docs, limit, id_col, text_col).withColumnRenamed("id", "gone")
    out = docs.select(named(id_col).alias("doc_id")).join(roots, F.col("doc_id") == F.col("gone"), "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), F.col("root").isNull().alias("keep"))


def near_dedup(docs: DataFrame, limit: int = MAX_BITS, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows of ``docs``, unchanged, without the near duplicates of a smaller id."""
    return drop_ids(docs, near_groups(docs, limit, id_col, text_col).select("id"), id_col)


def op6(spark, sf_dir):
    return op6_groups(read(spark, sf_dir, "documents"))
