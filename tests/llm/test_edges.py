"""Every operator on awkward and empty tables: no crash, and the result its docstring defines."""

import pytest
from pyspark.sql import functions as F

from inkspool.llm import exact, fingerprint, langid, linededup, mixing, packing, pii, simhash, toxicity, urlrules

from .data import AWKWARD, EXTRA, awkward, empty


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def model():
    good, bad = "the day is fine and we walk to the river with friends", "you are an idiot and we know it"
    return toxicity.fit([f"{bad} number {i}" for i in range(12)], [f"{good} number {i}" for i in range(24)])


OPS = {
    "mix": mixing.mix,
    "mix_filter": mixing.mix_filter,
    "langid": lambda d: langid.predict(d, langid.train(d)),
    "pack": packing.pack,
    "lines": lambda d: linededup.dedup_lines(d, min_docs=3, lost_col="lost"),
    "simhash": simhash.op6_groups,
    "near_dedup": simhash.near_dedup,
    "toxic": lambda d: toxicity.score(d, model()),
    "drop_toxic": lambda d: toxicity.drop_toxic(d, model()),
    "pii": lambda d: pii.pseudonyms(d, b"key"),
    "exact": exact.exact_groups,
    "fingerprint": fingerprint.fingerprints,
}


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](empty(spark)).count() == 0


@pytest.mark.parametrize("name", OPS)
@pytest.mark.parametrize("kind", ["string", "decimal(24,2)"])
def test_ids_keep_their_type(spark, name, kind):
    plain = awkward(spark)
    text = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("doc-" if kind == "string" else ""), F.col("doc_id").cast("string"), F.lit("" if kind == "string" else ".25"))).cast(kind)
    df = plain.withColumn("doc_id", text)
    a, b = OPS[name](plain), OPS[name](df)
    assert b.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert b.columns == a.columns
    ids = {str(r.doc_id).removeprefix("doc-").removesuffix(".25") for r in b.collect()}
    if not name.startswith("mix"):  # the mix goes by a hash of the id
        # the smallest of two ids need not be the same one as text
        assert len(ids) == len({r.doc_id for r in a.collect()}) and b.where("doc_id is null").count() == a.where("doc_id is null").count()


def test_empty_pages_and_null_urls(spark):
    schema = "page_id long, url string, html string, verdict string, rules string, token string"
    assert urlrules.verdicts(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "x", "y", "z"), (None, "http://m.casino-win.example.com/", None, "x", "y", "z"), (2, "", None, "x", "y", "z"), (3, "https://a.example.org/" + "p" * 50_000, None, "x", "y", "z"), (3, "https://a.example.org/" + "p" * 50_000, None, "x", "y", "z")]
    got = by_id(urlrules.verdicts(spark.createDataFrame(rows, schema)), "page_id")
    assert (got[1][0].verdict, got[1][0].rules, got[2][0].verdict) == ("none", "", "none")
    assert got[None][0].verdict == "block" and len(got[3]) == 2 and got[3][0].verdict == "allow"


def test_mix(spark):
    got = by_id(mixing.mix(awkward(spark), budgets=(0.5, 3.0)))
    assert {r for r in got if r is not None} == {r[0] for r in AWKWARD if r[0] is not None}
    assert len(got[5]) == 2 and len({r.mix_level for r in got[5]}) == 1
    assert got[2][0].n_tokens == 0 and len(got[None]) == 2
    kept = mixing.mix_filter(awkward(spark), budget=3.0)
    assert kept.count() == len(AWKWARD) and kept.columns == awkward(spark).columns


def test_mix_weights_and_ties(spark):
    df = awkward(spark).withColumn("doc_id", F.lit(1))
    # one id, so one hash: each source is in the mix with all rows or with none, and the one over its share with none
    size = {r.source: r["count"] for r in df.groupBy("source").count().collect()}
    kept = {r.source: r["count"] for r in mixing.mix(df, budgets=(0.1,)).groupBy("source").count().collect()}
    assert kept == {k: v for k, v in size.items() if k != "s1"}
    assert mixing.mix(df, budgets=(99.0,)).count() == len(AWKWARD)
    only = mixing.mix(awkward(spark), budgets=(9.0,), weights={"s3": 1.0})
    assert {r.source for r in only.where("n_tokens > 0").collect()} == {"s3"}


def test_langid(spark):
    got = by_id(langid.predict(awkward(spark), langid.train(awkward(spark))))
    assert sum(map(len, got.values())) == len(AWKWARD)
    assert got[2][0].lang_pred is None and got[3][0].lang_pred is None and got[6][0].lang_pred == "en"
    assert langid.train(awkward(spark).withColumn("lang", F.lit(None).cast("string"))) is None


def test_pack(spark):
    got = by_id(packing.pack(awkward(spark), size=100, docs_per_shard=4))
    assert not {2, 3, 4} & set(got)
    for i in (1, 6, 8):
        n = sum(r.n_tokens for r in got[i])
        assert n == len(next(t for d, t, *_ in AWKWARD if d == i).split())
    assert sum(r.n_tokens for r in got[5]) == 2 * sum(r.n_tokens for r in got[1])
    assert None in got


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lines(spark, limit):
    out = linededup.dedup_lines(awkward(spark), min_docs=3, lost_col="lost", max_broadcast=limit)
    assert out.columns == [*awkward(spark).columns, "lost"]
    got = by_id(out)
    assert "A shared line" in got[-11][0].text and got[-11][0].lost == 0
    assert "A shared line" not in got[1][0].text and got[1][0].lost >= 1
    assert got[2**62][0].text == "\n" and got[2**62][0].lost == 2
    assert got[2][0].text is None and got[3][0].text == "" and got[4][0].text == " \n\t "
    assert "A shared line" not in [r for r in got[None] if r.text][0].text
    assert len(got[5]) == 2 and all(r.h == EXTRA.index("h") for rs in got.values() for r in rs)


def test_simhash(spark):
    got = by_id(simhash.op6_groups(awkward(spark)))
    assert sum(map(len, got.values())) == len(AWKWARD)
    assert got[5][0].group_id == 1 and not got[5][0].keep and not got[5][1].keep
    assert got[10][0].group_id == 9 and got[9][0].keep
    assert all(got[i][0].group_id == i and got[i][0].keep for i in (2, 3, 4, 7))
    kept = simhash.near_dedup(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert {5, 10} & {r.doc_id for r in kept.collect()} == set() and kept.where("doc_id is null").count() == 2


def test_toxic(spark):
    m = model()
    got = by_id(toxicity.score(awkward(spark), m))
    assert got[2][0].score is None and not got[2][0].toxic and not got[3][0].toxic
    assert toxicity.drop_toxic(awkward(spark), m).count() + sum(r.toxic for rs in got.values() for r in rs) == len(AWKWARD)
    assert toxicity.score(awkward(spark), None).where("toxic").count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.train(awkward(spark), labels) is None


def test_pii(spark):
    got = by_id(pii.pseudonyms(awkward(spark), b"key"))
    for i, t, *_ in AWKWARD:
        if i is not None:
            assert got[i][0].text == t
    assert got[2][0].kinds is None and got[1][0].kinds == ""


def test_exact(spark):
    got = by_id(exact.exact_groups(awkward(spark)))
    assert [r.group_id for r in got[5]] == [1, 1] and not got[5][0].keep
    assert got[10][0].group_id == 9 and got[9][0].keep and got[2][0].content_hash is None and got[2][0].keep
    assert len(got[None]) == 2


def test_fingerprint(spark):
    got = by_id(fingerprint.fingerprints(awkward(spark)))
    assert got[2][0].state is None and got[3][0].paragraphs == 0 and set(bytes(got[3][0].state)) == {0}
    assert got[1][0].digest == got[5][0].digest == got[5][1].digest
    assert got[6][0].paragraphs == 2
