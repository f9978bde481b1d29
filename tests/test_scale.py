"""Operators whose hot group is spread over tasks, against plain Python."""

import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from trailbed import session
from trailbed.functions.text import path_stem, path_suffix, signed, tex_plain, thousands
from trailbed.operators import arms, audit, cohort, entities, evaluation, scoring, selection, stats
from trailbed.sources import models


def test_medians_by_group_with_a_hot_group(spark):
    r = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 40}", r.choice([r.gauss(0, 100), float(r.randint(0, 3)), None]), r.random()) for i in range(3000)] + [("none", None, None), (None, 1.0, 2.0), (None, 4.0, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {x.k: (x.median_a, x.median_b) for x in stats.medians(df, ["a", "b"], ["k"]).collect()}
    assert set(got) == {k for k, _, _ in rows} - {None} | ({None} if None in got else set())
    for k in got:
        if k is None:
            continue
        for i in (0, 1):
            vals = [x[i + 1] for x in rows if x[0] == k and x[i + 1] is not None]
            assert got[k][i] == (pytest.approx(median(vals), abs=1e-6) if vals else None)
    whole = stats.medians(df, ["a"]).first()[0]
    assert whole == pytest.approx(median(x[1] for x in rows if x[1] is not None), abs=1e-6)
    assert stats.medians(df.filter("false"), ["a"]).first()[0] is None and stats.medians(df.filter("false"), ["a"], ["k"]).isEmpty()


def test_running_medians(spark):
    r = random.Random(4)
    rows = [(f"{i:04}", None if i % 7 == 0 else r.random()) for i in range(333)]
    vals = [v for _, v in rows if v is not None]
    got = {x.point: (x.n, x.median) for x in stats.running_medians(spark.createDataFrame(r.sample(rows, len(rows)), "o string, v double"), "o", "v", 4).collect()}
    assert got == {p: (len(vals) * p // 4, pytest.approx(median(vals[: len(vals) * p // 4]), abs=1e-6)) for p in range(1, 5)}


def test_best_minus_single_needs_no_whole_buffer(spark):
    rows = [(f"k{i // 3}", i % 3, "r", float(i % 11), 0.0, i % 5 == 0) for i in range(300)]
    s = spark.createDataFrame(rows, "key string, cand_idx int, r string, s_suff double, s_nat double, leaked boolean")
    clean = [x for x in rows if not x[5]]
    best = [max(x[3] for x in clean if x[0] == k) for k in {x[0] for x in clean}]
    assert tuple(selection.best_minus_single(s).first())[:2] == (median(best), median(x[3] for x in clean))


def test_turns_of_a_runaway_session(spark):
    r = random.Random(5)
    rows = [("long", m, r.choice(["human", "gpt", "gpt"]), f"t{m}") for m in range(0, 3000, 2)] + [("short", 0, "human", "a"), ("short", 900, "human", "b"), ("short", 901, "gpt", "c")]
    got = {}
    for x in arms.merged_turns(spark.createDataFrame(rows, "sid string, msg_idx int, who string, value string"), "sid").collect():
        got[x.sid, x.turn] = (x.who, x.value)
    want = {}
    for sid in ("long", "short"):
        turn, last, out = 0, None, {}
        for _, _, who, v in [x for x in rows if x[0] == sid]:
            turn += who != last
            out[turn] = (who, out[turn][1] + "\n" + v) if who == last else (who, v)
            last = who
        if out[1][0] == "gpt":
            out[0] = ("human", "(continue)")
        want |= {(sid, k): v for k, v in out.items()}
    assert got == want


def test_controls_with_a_hot_session(spark):
    rows = [(f"h:{i}", "hot", i, 0, f"hot.{i}") for i in range(300)] + [(f"s{i}:0", f"s{i}", 0, 0, f"s{i}.0") for i in range(30)]
    a = spark.createDataFrame(rows, "key string, sid string, msg_idx int, block_idx int, real_thinking_summary string")
    got = scoring.random_control(a).collect()
    assert len(got) == 330 and all(r.other and r.other.split(".")[0] != r.sid for r in got)
    assert {(r.key, r.other) for r in got} == {(r.key, r.other) for r in scoring.random_control(a.orderBy("real_thinking_summary")).collect()}
    assert {r.other for r in scoring.random_control(a.filter("sid = 'hot'")).collect()} == {None}
    ring = scoring.mismatched(a).collect()
    assert len(ring) == 330 and len({r.other for r in ring}) == 31 and scoring.mismatched(a.limit(0)).isEmpty()
    same = a.withColumn("sid", F.concat(F.lit("session-0000"), "sid"))  # a common prefix of the ids
    assert len({r.other for r in scoring.mismatched(same).collect()}) == 31


def test_eligible_calls(spark):
    calls = spark.createDataFrame([("a", 1, 0, "Foreign"), ("a", 1, 1, "Read"), ("a", 1, 2, "Grep"), ("a", 2, 0, "Foreign"), ("b", 1, 0, "Read")], "session string, msg_idx int, block_idx int, name string")
    tools = spark.createDataFrame([("a", "Read"), ("a", "Grep"), ("a", "Grep"), ("b", "Read"), ("b", None)], "session string, name string")
    assert [tuple(r) for r in evaluation.eligible_calls(calls, tools).collect()] == [("a", 1, 1, "Read", 2)]


def test_maps_keys_and_forms(spark):
    pos = spark.createDataFrame([("s:1:0", "s", 1, 0, "Read"), ("s:1:2", "s", 1, 2, "Edit"), ("s:2:0", "s", 2, 0, "Read"), ("t:1:0", "t", 1, 0, "Odd")], "key string, sid string, msg_idx int, block_idx int, action_name string")
    m = evaluation.count_map(pos, "sid", "action_name").select("sid", evaluation.sum_values(F.col("counts")), evaluation.sum_of(F.col("counts"), ["Read", "Absent"])).collect()
    assert {tuple(r) for r in m} == {("s", 3, 2), ("t", 1, 0)}
    work = spark.createDataFrame([("s:1:9",), ("s:1:9",), ("zz:0:0",)], "key string")
    assert [tuple(r) for r in cohort.by_short_key(work, pos, "action_name").collect()] == [("s:1:9", "s:1", "Edit")]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(signed(F.lit(x), 2)) for x in (1.5, -2.0)] == ["+1.50", "-2.00"] and one(thousands(F.lit(1234567))) == "1,234,567"
    assert [(one(path_stem(F.lit(p))), one(path_suffix(F.lit(p)))) for p in ("a/b.tar.gz", "b", ".bashrc", "x/.env.local")] == [("b.tar", ".gz"), ("b", ""), (".bashrc", ""), (".env", ".local")]
    assert one(tex_plain(F.lit("\\textbf{12.5} \\pm{}"))) == "12.5"


def test_leaks_of_several_columns(spark):
    texts = spark.createDataFrame([("k", "clean", "use a_b", 5.0), ("k", "hindsight", "plain", 5.0), ("j", "clean", "c_d", None), ("none", "clean", "a_b", 9.0), ("k", "real", None, None)], "key string, kind string, text string, score double")
    secret = spark.createDataFrame([("k", "a_b"), ("k", "z_z"), ("j", "q_q")], "key string, entity string")
    got = {r.kind: (r.n, r.n_leaked, r.n_by_score, r.n_by_score_clean) for r in entities.leak_report_columns(texts, secret).collect()}
    assert got == {"clean": (2, 1, 1, 0), "hindsight": (1, 0, 1, 1), "real": (1, 0, 0, 0)}


def test_gates(spark):
    claims = spark.createDataFrame([("a", "10.0%", 0.05, False), ("b", "10.0%", 0.05, False), ("c", "10.0%", 0.05, True)], "claim string, stated string, tolerance double, relative boolean")
    metrics = spark.createDataFrame([("a", 10.04), ("b", 10.06), ("c", 10.4)], "claim string, value double")
    assert {r.claim: r.verdict for r in audit.verify_claims(claims, metrics).collect()} == {"a": "ok", "b": "differs", "c": "ok"}
    rows = spark.createDataFrame([("x", "results/a.json"), ("y", ""), ("z", None), ("w", "none")], "claim string, source string")
    assert {r.claim for r in audit.without_source(rows).collect()} == {"y", "z", "w"}
    files = spark.createDataFrame([("a", 1), ("b", 0)], "path string, length long")
    assert {r.path for r in audit.absent(files, spark.createDataFrame([("a",), ("b",), ("c",)], "path string")).collect()} == {"b", "c"}
    tex = spark.createDataFrame([(1, "\\section{A} % status: done\n\\num{} x\n\\section{B}\n\\todo{y}\n\\section{C} % status: done fine")], "doc int, text string")
    assert [(r.section, r.n_marks) for r in audit.unfinished(tex, "doc", "text").collect()] == [(0, 1)]


def test_generation_tells_failures_from_empty_answers(spark):
    def client(prompt, n):
        if prompt == "busy":
            raise TimeoutError("later")
        if prompt == "wrong":
            raise ValueError("no")
        return []

    df = spark.createDataFrame([("a", "busy"), ("b", "wrong"), ("c", "ok")], "key string, prompt string")
    got = {r.key: (r.raw, r.error) for r in models.generate(df, client, tries=2, wait=0.0).collect()}
    assert got == {"a": ([], "TimeoutError: later"), "b": ([], "ValueError: no"), "c": ([], None)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Option:
        def isDefined(self):
            return False

    class Context:
        master, _jsc = "spark://host:7077", None

        def getConf(self):
            return Conf()

    class Fake:
        sparkContext, conf = Context(), Conf()

    Fake.sparkContext._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Option()})()})()
    with pytest.raises(RuntimeError, match="share"):
        session.shared_dir(Fake())


def test_discard(spark):
    t = session.materialize(spark.range(3).toDF("x"), "gone")
    path = session._written[t]
    session.discard(t)
    session.discard(t)
    assert not __import__("os").path.exists(path.removeprefix("file://"))


def test_shards_are_even(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    n = Counter(i for i in range(4) for _ in range(keys.filter(cohort.in_shard(F.col("key"), i, 4)).count()))
    assert sum(n.values()) == 4000 and min(n.values()) > 850
