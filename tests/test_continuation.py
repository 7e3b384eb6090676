import random

from inkspool.operators import continuation as con

B = "chapter_id long, panel_id int, reading_order int, text string, left int, top int, right int, bottom int, word_count long"


def merged(spark, panels, height=500):
    rows, ps = [], []
    for k, bs in enumerate(panels):
        ps.append((1, k, height))
        rows += [(1, k, i + 1, t, x, y, x + w, y + h, len(t.split())) for i, (t, w, h, x, y) in enumerate(bs)]
    p = spark.createDataFrame(ps, "chapter_id long, panel_id int, height int")
    b = spark.createDataFrame(rows, B)
    exact = [r.text for r in con.merge(b, p).orderBy("bubble_idx").collect()]
    native = sorted(r.text for r in con.merge_native(b, p).collect())
    assert native == sorted(exact)
    return exact


def test_fixtures(spark):
    first = ("Hey, what are you", 200, 50, 100, 450)
    assert merged(spark, [[first], [("doing over there?", 200, 40, 100, 10)]]) == ["Hey, what are you doing over there?"]
    assert len(merged(spark, [[first], [("doing over there?", 200, 40, 400, 10)]])) == 2
    assert len(merged(spark, [[("That is interesting.", 200, 50, 100, 450)], [("What do you think?", 200, 40, 100, 10)]])) == 2
    assert len(merged(spark, [[("Hey, what", 200, 50, 100, 200)], [("now", 200, 40, 100, 100)]])) == 2
    assert len(merged(spark, [[("Start here", 200, 50, 100, 450)], [], [("End here.", 200, 40, 100, 10)]])) == 2
    assert merged(spark, [[first]]) == ["Hey, what are you"]


def test_two_pairs_in_order(spark):
    a = [("one and", 150, 50, 50, 450), ("two and", 150, 50, 250, 450)]
    b = [("uno.", 150, 40, 50, 10), ("due.", 150, 40, 250, 10)]
    assert merged(spark, [a, b]) == ["one and uno.", "two and due."]


def test_chains_and_random_panels(spark):
    chain = [[("a", 200, 490, 100, 5)] for _ in range(6)]
    assert merged(spark, chain) == ["a a a a a a"]
    rng = random.Random(4)
    for _ in range(3):
        panels = []
        for _ in range(6):
            panels.append([(rng.choice(["go on", "end.", "well,", "what?"]), rng.randrange(50, 300), 60, rng.randrange(0, 400), rng.choice([5, 40, 200, 400, 440])) for _ in range(rng.randrange(0, 5))])
        words = sorted(w for p in panels for b in p for w in b[0].split())
        assert sorted(w for t in merged(spark, panels) for w in t.split()) == words


def test_sentence_ends_never_match(spark):
    df = spark.createDataFrame([("Done.", 0), ("Why?", 1), ("go…", 2), ("", 3), ("and", 4)], "text string, i int")
    got = [r[0] for r in df.orderBy("i").select(con.incomplete(df.text)).collect()]
    assert got == [False, False, True, False, True]


def model(panels, height):
    """The fold written anew: every panel's bubbles against the last ten of those so far that touch the bottom of the panel before."""
    out = []  # [text, left, top, right, bottom, panel]
    last = None
    for k, bs in enumerate(panels):
        if not bs:
            continue
        free = list(range(len(bs)))
        if last == k - 1:
            waiting = [i for i, o in enumerate(out) if height - o[4] <= 50][-10:]
            for i in waiting:
                for j in list(free):
                    t, w, h, x, y = bs[j]
                    o = out[i]
                    if y > 50 or k - o[5] > 1 or not fits(o, (x, x + w)):
                        continue
                    out[i] = [f"{o[0]} {t}", x, y, x + w, y + h, k]
                    free.remove(j)
                    break
        out += [[bs[j][0], bs[j][3], bs[j][4], bs[j][3] + bs[j][1], bs[j][4] + bs[j][2], k] for j in free]
        last = k
    return [o[0] for o in out]


def fits(o, b):
    """Aligned by 0.6 of the narrower one, less where centres are apart; and the text goes on."""
    (l1, r1), (l2, r2) = (o[1], o[3]), b
    w1, w2 = r1 - l1, r2 - l2
    common = min(r1, r2) - max(l1, l2)
    if common <= 0 or 0 in (w1, w2):
        return False
    a, apart, mean = common / min(w1, w2), abs((l1 + r1) - (l2 + r2)) / 2, (w1 + w2) / 2
    if apart > mean / 2:
        a *= 1 - min(1, apart / mean) / 2
    return a >= 0.6 and o[0].strip()[-1] not in ".!?"


def test_fold_equals_a_model_also_beyond_ten_candidates(spark):
    rng = random.Random(11)
    for n in (3, 16, 30):
        panels = []
        for _ in range(5):
            panels.append([(rng.choice(["go on", "end.", "well,", "and so"]) if rng.random() < 0.7 else "one, ", rng.randrange(60, 120), 40, rng.randrange(0, 900), rng.choice([5, 30, 440])) for _ in range(n)])
        rows = [(1, k, i + 1, t, x, y, x + w, y + h, len(t.split())) for k, bs in enumerate(panels) for i, (t, w, h, x, y) in enumerate(bs)]
        p = spark.createDataFrame([(1, k, 500) for k in range(5)], "chapter_id long, panel_id int, height int")
        got = [r.text for r in con.merge(spark.createDataFrame(rows, B), p).orderBy("bubble_idx").collect()]
        assert got == model(panels, 500)
        assert n < 16 or len(got) < 5 * n
