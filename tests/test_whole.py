"""Queries over small tables whose telling parts lie where a shorter cut would lose them."""

import math
from statistics import median

import pytest
from pyspark.sql import functions as F

from trailbed.operators.positions import positions
from trailbed.plans.queries import QUERIES

BLOCK = "block_id long, session_id string, msg_idx int, block_idx int, role string, type string, name string, content string, input string"
CANDIDATE = ["Grep finds alpha here", "nothing of the kind"]


def lp(prefix, target):
    p, t = prefix.split(), target.split()
    return sum(math.log((p.count(w) + 1) / (len(p) + 10_000)) for w in t), len(t)


@pytest.fixture(scope="module")
def long_sessions(spark, tmp_path_factory):
    """Two sessions of two anchored calls; the words that the calls and thoughts share lie over 8,000, 11,000 and 23,000 characters back."""
    rows = []
    for s in "ab":
        rows += [
            (s, 0, 0, "user", "text", None, "deep" + s + " " + "x " * 5500, None), (s, 0, 1, "user", "text", None, "mid" + s + " " + "y " * 1500, None),
            (s, 0, 2, "user", "text", None, "Grep alpha " + s + " " + "z " * 4000, None), (s, 0, 3, "user", "tool_result", None, "r" * 790 + " " + "w " * 200, None),
        ]
        for m in (1, 2):
            rows += [(s, m, 0, "assistant", "thinking", None, f"deep{s} mid{s} Grep {s} {m}", None), (s, m, 1, "assistant", "tool_use", "Grep" if m == 1 else "Bash", None, f"deep{s} mid{s} alpha")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], BLOCK)
    d = str(tmp_path_factory.mktemp("long"))
    df.write.parquet(f"{d}/blocks.parquet")
    pos = positions(df)
    pos.drop("key", "has_thinking_block").write.parquet(f"{d}/positions.parquet")
    pos.select("key", F.array(*map(F.lit, CANDIDATE)).alias("candidates"), F.lit("p").alias("provider")).write.parquet(f"{d}/candidates.parquet")

    def context(s, m, n, call=400, result=800):
        shown = {"text": lambda r: f"[{r[3]}] {r[6]}", "tool_use": lambda r: f"[{r[3]} 调用 {r[5]}] {r[7][:call]}", "tool_result": lambda r: f"[工具返回] {r[6][:result]}"}
        return "\n".join(shown[r[4]](r) for r in rows if r[0] == s and r[1] < m and r[4] in shown)[-n:]

    return d, pos.collect(), context


def action(p):
    return f"调用工具 {p.action_name},参数: {p.action_input[:400]}"


def test_scores_see_the_whole_context(spark, long_sessions):
    d, pos, context = long_sessions
    got = {(r.key, r.cand_idx): r for r in QUERIES["stand_in_scores_9000"](spark, d).collect()}
    assert len(got) == 8
    for p in pos:
        c = context(p.sid, p.msg_idx, 9000)
        for i, r in enumerate(CANDIDATE):
            base, (nat, n) = lp(c, action(p))[0], lp(c, r)
            g = got[p.key, i]
            assert (g.base, g.s_suff, g.s_nat) == pytest.approx((base, lp(c + "\n" + r, action(p))[0] - base, nat / n), abs=2e-6)


def test_reports_see_the_whole_context(spark, long_sessions):
    d, pos, context = long_sessions
    c = {p.key: context(p.sid, p.msg_idx, 9000) for p in pos}
    think, act = [lp(c[p.key], p.real_thinking_summary[:800]) for p in pos], [lp(c[p.key], action(p)) for p in pos]
    r = QUERIES["intrinsic_report"](spark, d).first()
    assert r.think_ppl == pytest.approx(math.exp(-sum(x for x, _ in think) / sum(n for _, n in think)), rel=1e-6)
    assert r.action_lp_per_tok == pytest.approx(sum(x for x, _ in act) / sum(n for _, n in act), abs=2e-6)
    assert {x.guess for x in QUERIES["action_top1"](spark, d).collect()} == {"Grep"}
    assert {(x.tool, x.n, x.acc) for x in QUERIES["per_tool_accuracy"](spark, d).collect()} == {("Grep", 2, 1.0), ("Bash", 2, 0.0)}


def test_controls_see_the_whole_context(spark, long_sessions):
    d, pos, context = long_sessions
    first = {p.sid: p.real_thinking_summary for p in sorted(pos, key=lambda p: p.key, reverse=True)}
    suff = lambda c, p, r: lp(c + "\n" + r, action(p))[0] - lp(c, action(p))[0]
    c = {p.key: context(p.sid, p.msg_idx, 24000, 600, 1200) for p in pos}
    own = [suff(c[p.key], p, p.real_thinking_summary) for p in pos]
    other = [suff(c[p.key], p, first["b" if p.sid == "a" else "a"]) for p in pos]
    r = QUERIES["ruler_validation"](spark, d).first()
    assert (r.n, r.median_own, r.median_other) == (4, pytest.approx(median(own), abs=2e-6), pytest.approx(median(other), abs=2e-6))
    base = sorted(lp(context(p.sid, 1, 12000), action(p))[0] for p in pos if p.msg_idx == 1)
    r = QUERIES["dual_calibration"](spark, d).first()
    assert (r.n, r.base_q50) == (2, pytest.approx(median(base), abs=2e-6))


def test_prompts_hold_the_whole_context(spark, long_sessions):
    d, pos, context = long_sessions
    for name, how in (("prompts_coarse_9000", (9000,)), ("prompts_full_24000", (24000, 600, 1200))):
        got = {r.key: r.prompt for r in QUERIES[name](spark, d).collect()}
        assert len(got) == 4 and all(got[p.key].startswith(context(p.sid, p.msg_idx, *how) + "\n\n下一步动作") for p in pos), name
