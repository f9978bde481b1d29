import random
from collections import defaultdict

import numpy as np
import pytest

from trailbed.llm.codes import Spans, code_points, gram_hashes
from trailbed.llm.hot import hot_keys, join_hot
from trailbed.llm.shared_spans import shared_shares, shared_spans


def brute(rows, span):
    seen = defaultdict(set)
    for d, t in rows:
        for p in range(len(t or "") - span + 1):
            seen[t[p : p + span]].add(d)
    out = set()
    for d, t in rows:
        run = None
        for p in range(len(t or "") - span + 1):
            if len(seen[t[p : p + span]]) > 1:
                if run and p <= run[1]:
                    run[1] = p + span
                else:
                    if run:
                        out.add((d, *run))
                    run = [p, p + span]
        if run:
            out.add((d, *run))
    return out


def made(seed):
    r = random.Random(seed)
    letters = r.choice(["ab", "abcdefgh ", "ab\n字😀", "a"])
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    pool = [word(r.randint(40, 300)) for _ in range(4)] + ["ab" * 100, "x" * 150, "-" * 90 + "\n" + "=" * 90]
    rows = [(i, "".join(r.choice(pool)[r.randint(0, 20) :] if r.random() < 0.5 else word(r.randint(0, 120)) for _ in range(r.randint(0, 5)))) for i in range(25)]
    return rows + [(100, None), (101, ""), (102, rows[3][1]), (103, rows[3][1]), (104, "q" * 2000)]


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, digest string")
    got = [tuple(r) for r in shared_spans(df, 70).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 70)


def test_shares_cover_every_document(spark):
    rows = made(3)
    runs = brute(rows, 70)
    got = {r.doc_id: r for r in shared_shares(spark.createDataFrame(rows, "doc_id long, text string"), 70).collect()}
    assert set(got) == {d for d, _ in rows}
    for d, t in rows:
        assert got[d].shared_chars == sum(e - b for x, b, e in runs if x == d) and got[d].n_chars == len(t or "")


def test_header_in_a_third_of_the_documents(spark):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    head = text(400)
    rows = [(d, (head if d % 3 == 0 else "") + text(150)) for d in range(240)]
    got = {tuple(x) for x in shared_spans(spark.createDataFrame(rows, "doc_id long, text string"), 70).collect()}
    assert got == brute(rows, 70) and len(got) == 80


def test_join_hot_equals_join(spark):
    rows = spark.createDataFrame([(1 if i % 3 == 0 else i, i) for i in range(900)] + [(None, 5)], "k long, x long")
    facts = spark.createDataFrame([(i, i * i) for i in range(0, 900, 2)] + [(1, 1)], "k long, y long").dropDuplicates(["k"])
    want = {tuple(r) for r in rows.join(facts, "k").collect()}
    for hot in (hot_keys(rows, share=2), hot_keys(rows).limit(0)):
        got = [tuple(r) for r in join_hot(rows, facts, "k", hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    assert shared_spans(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_hashes_follow_content():
    c = code_points("abcabcabcx" * 3)
    for k in range(1, 12):
        h, by = gram_hashes(c, k), {}
        for i in range(len(h)):
            assert by.setdefault(bytes(c[i : i + k]), h[i]) == h[i]
        assert len(set(by.values())) == len(by)
    s = Spans(c)
    assert s.hash(np.array([0]), np.array([10])) == s.hash(np.array([10]), np.array([20]))
    assert s.hash(np.array([0]), np.array([3])) != s.hash(np.array([0]), np.array([4]))
