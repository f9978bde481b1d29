import random

import pytest

from trailbed.llm.packing import TOKENIZERS, fill_report, pack, token_counts


def test_packing_keeps_every_token(spark):
    r = random.Random(5)
    counts = [(i, int(r.paretovariate(1.1) * 20)) for i in range(3000)] + [(9000, 0), (9001, None), (9002, 5000)]
    df = spark.createDataFrame([(*c, "x") for c in counts], "doc_id long, n_tokens int, capacity string")
    specs = spark.createDataFrame([(1, 512), (2, 2048), (2, 2048), (3, 0), (4, None)], "spec_id int, capacity int")
    packed = pack(df, specs, shard=20).collect()
    for spec, cap in ((1, 512), (2, 2048)):
        mine = [p for p in packed if p.spec_id == spec]
        whole = {}
        for p in sorted(mine, key=lambda p: (p.doc_id, p.piece)):
            assert p.first_token == whole.get(p.doc_id, 0)
            whole[p.doc_id] = p.first_token + p.n_tokens
        assert whole == {d: n for d, n in counts if n}
        assert all(p.n_tokens == cap or p.first_token + p.n_tokens == whole[p.doc_id] for p in mine)
        load = {}
        for p in mine:
            load[p.container] = load.get(p.container, 0) + p.n_tokens
        assert max(load.values()) <= cap
    assert {p.spec_id for p in packed} == {1, 2}
    report = {x.spec_id: x for x in fill_report(pack(df, specs, shard=20), specs).collect()}
    assert report[1].unused < 0.03 and report[2].unused < 0.03


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens int")
    specs = spark.createDataFrame([(1, 10)], "spec_id int, capacity int")
    assert pack(none, specs).isEmpty() and pack(none, specs.limit(0)).isEmpty()


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|> 字😀"), (5, " ")], "doc_id long, text string")
    try:
        got = {r.doc_id: r.n_tokens for r in token_counts(docs, TOKENIZERS).collect()}
    except Exception as e:  # noqa: BLE001
        if "No such file" in str(e):
            pytest.skip("no vocabulary")
        raise
    assert set(got) == {1, 4, 5} and got[1] == 2 and got[4] > 3
