"""The corpus pipeline against a brute-force version of each stage."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from inkspool.llm import mixing, packing, simhash, toxicity
from inkspool.llm.common import text_bytes

from .data import EXTRA, awkward, empty

SF1 = "/root/testdata/sf0.01"


def brute_lines(rows):
    seen, size = {}, {r["doc_id"]: len(r["text"].encode()) for r in rows}
    for r in rows:
        for x in {y.strip(" \t\r") for y in r["text"].split("\n")} - {""}:
            seen.setdefault(x, []).append(r["doc_id"])
    owner = {x: min(ids) for x, ids in seen.items() if len(ids) >= 2}
    out = []
    for r in rows:
        lines, i = r["text"].split("\n"), r["doc_id"]
        shared = {}
        for x in lines:
            x = x.strip(" \t\r")
            if owner.get(x, i) != i:
                shared[owner[x]] = shared.get(owner[x], 0) + len(x.encode())
        copied = {o for o, n in shared.items() if n >= corpus_pipeline.NEAR_COPY * max(size[i], size[o])}
        text = "\n".join(x for x in lines if owner.get(x.strip(" \t\r"), i) in {i, *copied})
        if text == r["text"] or text.strip(" \t\r\n"):
            out.append(r | {"text": text})
    return out


def brute_near(rows):
    fp, has = simhash.fingerprints(*text_bytes(pa.array([r["text"].lower() for r in rows])))
    ids = [r["doc_id"] for r in rows]
    root = dict(zip(ids, ids, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(simhash.popcount(fp[i + 1 :] ^ fp[i]) <= simhash.MAX_BITS):
            if has[i] and has[i + 1 + j]:
                a, b = sorted((find(ids[i]), find(ids[i + 1 + j])))
                root[b] = a
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF1}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    s = toxicity._scores(model, [r["text"] for r in rows])
    rows = [r for r, x in zip(rows, s, strict=True) if not x >= model.threshold]
    names = ["toxicity", "line_dedup", "simhash_near_dedup"]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:3], (lambda r: r, brute_lines, brute_near), strict=True):
        out = stage(spark, docs, SF1)
        assert out.columns == docs.columns and name == names.pop(0)
        rows = brute(rows)
        got = {r.doc_id: r.text for r in out.collect()}
        want = {r["doc_id"]: r["text"] for r in rows}
        if name == "simhash_near_dedup":  # an approximate search: it may keep a few more
            assert set(want) <= set(got) and len(got) <= 1.02 * len(want)
            rows = [r for r in rows if r["doc_id"] in got]
            out = out.where(F.col("doc_id").isin(list(want)))
        else:
            assert got == want
        out = spark.createDataFrame(out.collect(), docs.schema)
        docs = out
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF1)
    assert mixed.columns == docs.columns
    level = mixing.mix(docs, budgets=(1.0,))
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in level.collect()}
    packed = corpus_pipeline.packing_stage(spark, mixed, SF1)
    tokens = mixed.select(F.sum(packing.word_count(F.col("text")))).first()[0]
    assert packed.agg(F.sum("n_tokens")).first()[0] == tokens


def test_whole_run_and_registration(spark):
    out = __spark_entry__.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["window_id", "slot", "doc_id", "start_token", "n_tokens"] and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "packing"]


def test_stages_take_awkward_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    for df in (awkward(spark), empty(spark)):
        n = df.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == df.columns
            assert out.count() <= n
        corpus_pipeline.packing_stage(spark, df, sf).count()
    assert len(awkward(spark).columns) == 5 + len(EXTRA)


def test_documents_without_a_line_of_their_own_go(spark):
    parts = [f"Line {i} that others share, with some words to it" for i in range(8)]
    rows = [(i, f"{p}\nmy own {i}", "en", "s", 50) for i, p in enumerate(parts)] + [(8, "\n".join(parts), "en", "s", 400), (9, None, "en", "s", 0), (10, " ", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.line_dedup_stage(spark, df, "").collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 10]


def test_copies_reach_the_near_dedup_whole(spark):
    rows = [(i, "One line that all share", "en", "s", 23) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.line_dedup_stage(spark, df, "")
    assert out.count() == 8 and [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, out, "").collect()] == [0]
