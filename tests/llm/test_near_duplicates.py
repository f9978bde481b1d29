import random

import pytest
from pyspark.sql import functions as F

from trailbed.llm.hot import hot_keys
from trailbed.llm.near_duplicates import NearDuplicates, components, pairs_within, record_text


def grams(t):
    return {t[i : i + 9] for i in range(len(t) - 8)}


def brute(rows, least):
    g = {i: grams(t) for i, t in rows if t}
    ids = sorted(i for i in g if g[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(g[a] & g[b]) >= least * len(g[a] | g[b])}


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    rows = []
    for f in range(12):
        base = [word() for _ in range(r.randint(20, 150))]
        for _ in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 12))):
                k = r.randrange(len(t))
                x = r.random()
                t[k : k + 1] = [] if x < 0.3 else [word()] if x < 0.6 else [t[k], word()]
            if r.random() < 0.3:
                k = len(t) // 2
                t = t[k:] + t[:k]
            rows.append((len(rows), " ".join(t)))
    rows += [(500 + i, rows[0][1]) for i in range(6)] + [(600, None), (601, ""), (602, "short"), (603, "short"), (604, "x" * 40), (605, "x" * 90)]
    return rows


def near(pair, rows):
    t = dict(rows)
    a, b = grams(t[pair[0]]), grams(t[pair[1]])
    return len(a & b) / len(a | b)


def test_equals_brute_force(spark):
    found = wanted = 0
    for seed in range(3):
        rows = made(seed)
        df = spark.createDataFrame([(*x, 1) for x in rows], "rec_id long, text string, a int")
        nd = NearDuplicates(df, cell_chars=8_000)
        got = [tuple(x) for x in nd.pairs().collect()]
        want = brute(rows, 0.6)
        assert len(got) == len(set(got)) and set(got) <= want
        missed = want - set(got)
        assert all(near(p, rows) < 0.66 for p in missed)  # a miss is possible only close to the threshold
        found, wanted = found + len(got), wanted + len(want)
        deg = {x.rec_id: x for x in nd.degrees().collect()}
        assert set(deg) == {i for i, t in rows if t is not None} and deg[503].class_id == 0
        parent = {i: i for i in deg}

        def top(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in got:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
        groups = {x.rec_id: x.group_id for x in nd.groups().collect()}
        assert all(groups[i] == top(i) for i in deg if i not in (602, 603))
    assert found >= 0.99 * wanted


def test_pairs_of_a_hot_key_are_split_and_whole(spark):
    df = spark.createDataFrame([("h", i) for i in range(40)] + [("k", 1), ("k", 2), ("l", 3), (None, 4), (None, 5), ("h", None)], "v string, i long")
    for block in (7, 1000):
        got = [tuple(r) for r in pairs_within(df, "v", "i", block).collect()]
        assert sorted(got) == sorted([(a, b) for a in range(40) for b in range(a + 1, 40)] + [(1, 2)])


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (100, 102), (200, 205)]
    random.Random(3).shuffle(chain)
    got = {r.id: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200, 205: 200}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_components_raise_when_not_stable(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError, match="not stable after 2"):
        components(chain, rounds=2)


def test_record_text(spark):
    df = spark.createDataFrame([(1, "A-b", [("u", "Ü 3_x"), ("v", None), None]), (2, None, []), (3, None, None)], "rec_id long, system string, messages array<struct<role string, content string>>")
    assert [r.t for r in df.select(record_text().alias("t")).collect()] == ["a b ü 3 x", "", None]
    assert NearDuplicates(df.limit(0).select("rec_id", record_text().alias("text"))).pairs().isEmpty()
    assert df.filter(F.size("messages") > 0).count() == 1


def test_hot_variant_is_split(spark):
    """One key holds a third of all rows: every pair is found, and no task joins more than two blocks of it."""
    rows = [(1, i) for i in range(600)] + [(1000 + i // 2, i) for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, x long")
    got = {(r.a, r.b) for r in pairs_within(df, "k", "x", block=100).collect()}
    assert got == {(i, j) for i in range(600) for j in range(i + 1, 600)} | {(i, i + 1) for i in range(0, 1200, 2)}
    assert hot_keys(df, share=4).first().k == 1

