"""The SimHash search: recall at its limit, exactness in buckets, many copies that differ, independence of other documents."""

import time

import numpy as np
import pyarrow as pa
import pytest

from inkspool.llm import simhash
from inkspool.llm.common import text_bytes

from .data import docs


def flipped(rng, prints, d):
    """Each print with d of its bits changed."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)
    for row in bits:
        row[rng.choice(simhash.BITS, d, replace=False)] ^= 1
    return np.packbits(bits, axis=1).view(np.uint64)


def random_prints(rng, n):
    return rng.integers(0, 2**64, (n, simhash.WORDS), dtype=np.uint64)


def search(prints, parts=3):
    _, blobs = simhash.spread_entries(np.arange(len(prints)), prints, parts)
    edges = [simhash.entry_edges(np.frombuffer(b.as_buffer(), simhash.ENTRY)) for b in blobs]
    return simhash.labels(len(prints), *(np.concatenate([e[k] for e in edges]) for k in (0, 1)))


def brute(prints, bucket=None):
    near = simhash.distances(prints, prints) <= simhash.MAX_BITS
    if bucket is not None:
        near &= bucket[:, None] == bucket[None, :]
    return simhash.labels(len(prints), *np.nonzero(near))


@pytest.mark.parametrize(("bits", "least"), [(36, 0.995), (40, 0.98), (44, 0.97)])
def test_recall_at_the_limit(bits, least):
    rng = np.random.default_rng(bits)
    a = random_prints(rng, 2000)
    label = search(np.concatenate([a, flipped(rng, a, bits)]))
    assert (label[:2000] == label[2000:]).mean() >= least


def test_search_of_a_large_corpus_finds_pairs_at_the_limit(spark):
    rng = np.random.default_rng(3)
    a = random_prints(rng, 600)
    fp = np.concatenate([a, flipped(rng, a, simhash.MAX_BITS)]).view(np.int64)
    distinct = spark.createDataFrame([(k, *map(int, f)) for k, f in enumerate(fp)], "id long, f0 long, f1 long, f2 long, f3 long")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.near_edges(distinct).collect()}
    assert sum((k, k + 600) in found for k in range(600)) >= 0.94 * 600


def mixed_prints(rng):
    """Loose and tight clusters, a chain, and unrelated prints, in Gray order."""
    parts = [random_prints(rng, 150)]
    for d in (2, 10, 20, 30):
        parts.append(flipped(rng, np.repeat(random_prints(rng, 1), 40, axis=0), d))
    chain = [random_prints(rng, 1)]
    for _ in range(20):
        chain.append(flipped(rng, chain[-1], 40))
    fp = np.concatenate([*parts, *chain])
    return fp[np.argsort(simhash.gray_rank(fp[:, 0]))]


@pytest.mark.parametrize("seed", range(4))
def test_buckets_are_searched_without_loss(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    fp = mixed_prints(rng)
    bucket = rng.integers(0, 4, len(fp)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    fp, bucket = fp[order], bucket[order]
    want = brute(fp, bucket)
    for large in (10_000, 2):  # all buckets together, and each on its own
        monkeypatch.setattr(simhash, "LARGE", large)
        found = list(simhash.bucket_edges(fp, bucket, simhash.MAX_BITS))
        assert (simhash.labels(len(fp), *(np.concatenate([e[k] for e in found]) for k in (0, 1))) == want).all()


def test_a_bucket_that_is_cut_again_keeps_its_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    a = random_prints(rng, 500)
    fp = np.concatenate([a, flipped(rng, a, simhash.MAX_BITS)])
    monkeypatch.setattr(simhash, "LEAF", 100)
    label = simhash.large_bucket(fp, simhash.MAX_BITS)
    assert (label[:500] == label[500:]).mean() >= 0.97 and len(np.unique(label)) >= 500


def test_upper_nodes_prune(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("lower(text) t").toArrow().column("t").combine_chunks()
    fp, has = simhash.fingerprints(*text_bytes(t))
    fp = np.unique(fp[has], axis=0)
    keys = simhash.table_keys(fp)
    asked = left = 0
    for k in range(simhash.TABLES):
        order = np.lexsort((simhash.gray_rank(fp[:, k % simhash.WORDS]), keys[:, k]))
        index = simhash.GrayIndex(fp[order], keys[order, k])
        list(index.edges(simhash.MAX_BITS))
        asked, left = asked + index.asked, left + index.left
    assert asked > 10_000 and left > 0.9 * asked


def test_twenty_thousand_copies_that_differ():
    rng = np.random.default_rng(7)
    fp = flipped(rng, np.repeat(random_prints(rng, 1), 20_000, axis=0), 15)
    t = time.perf_counter()
    label = search(fp, 1)
    assert time.perf_counter() - t < 60 and not label.any()


def test_other_documents_change_no_group(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(80) for _ in range(150)]
    near = [" ".join(w if rng.random() > 0.06 else "new" + w for w in t.split()) for t in base]
    rows = [(i, t, "en", "s") for i, t in enumerate(base + near)]
    others = [(10_000 + i, text(60), "en", "s") for i in range(3000)]
    few = {r.doc_id: r.group_id for r in simhash.op6_groups(docs(spark, rows)).collect()}
    many = {r.doc_id: r.group_id for r in simhash.op6_groups(docs(spark, rows + others)).collect()}
    assert few == {i: many[i] for i in few} and sum(few[i + 150] == i for i in range(150)) > 100


def test_rows_of_one_id_are_one_document(spark):
    rows = [("b", "alpha beta gamma delta"), ("b", "one two three four five"), ("a", "one two three four five"), ("c", "alpha beta gamma delta"), ("d", "quite another text of words")]
    got = {(r.doc_id, r.group_id, r.keep) for r in simhash.op6_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("a", "a", True), ("b", "a", False), ("c", "a", False), ("d", "d", True)}


def test_pieces_of_long_texts_vote_together():
    words = [f"word{i}" for i in range(400_000)]
    long = " ".join(words)
    fp, _ = simhash.fingerprints(*text_bytes(pa.array([long, " ".join(reversed(words))])))
    assert (fp[0] == fp[1]).all()
