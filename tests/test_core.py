from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailbed.functions.text import agrees, entities, norm_number, parse_candidates, strip_ws
from trailbed.operators import arms, audit, candidates, cohort, context, evaluation, scoring, selection, stats
from trailbed.operators import entities as names
from trailbed.operators.positions import latest_blocks, positions

BLOCK = "block_id long, session_id string, msg_idx int, block_idx int, role string, type string, name string, content string, input string"


def blocks(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], BLOCK)


BASIC = [
    ("s", 0, 0, "user", "text", None, "please fix src/a_b.py", None),
    ("s", 1, 0, "assistant", "tool_use", "Read", None, '{"path":"src/x.py"}'),
    ("s", 1, 1, "assistant", "thinking", None, "late thought", None),
    ("s", 1, 2, "assistant", "tool_use", None, None, None),
    ("s", 2, 0, "user", "tool_result", None, "found fooBar on line 120", None),
    ("s", 3, 0, "assistant", "thinking", None, " \t  ", None),
    ("s", 3, 1, "assistant", "tool_use", "Edit", None, '{"name":"fooBar","to":"BarBaz"}'),
    ("s", 4, 0, "assistant", "text", None, "done", None),
]


def test_positions(spark):
    got = {r.key: r for r in positions(blocks(spark, BASIC)).collect()}
    assert set(got) == {"s:1:0", "s:1:2", "s:3:1"}
    assert got["s:1:0"].real_thinking_summary == "late thought" and got["s:1:0"].has_real_thinking
    assert got["s:1:2"].real_thinking_summary is None and got["s:1:2"].action_name == "?" and got["s:1:2"].action_input == "{}"
    assert got["s:3:1"].has_thinking_block and not got["s:3:1"].has_real_thinking


def test_latest_blocks_keeps_last_delivery(spark):
    df = blocks(spark, [BASIC[0], BASIC[0][:6] + ("again", None), BASIC[1]])
    assert {(r.msg_idx, r.content) for r in latest_blocks(df).collect()} == {(0, "again"), (1, None)}


def test_context_equals_plain_concatenation(spark):
    rows = [("a", m, b, "user", "text", None, "é😀" * ((m * 7 + b) % 5) + f"{m}.{b}", None) for m in range(0, 40) for b in range(m % 3)]
    rows += [("b", 5, 0, "user", "text", None, "x" * 100, None), ("b", 700, 0, "user", "text", None, None, None), ("b", 701, 0, "user", "thinking", None, "no", None)]
    df = blocks(spark, rows)
    at = spark.createDataFrame([("a", m) for m in range(0, 42)] + [("b", 0), ("b", 5), ("b", 6), ("b", 701), ("c", 3), ("b", 6)], "session_id string, msg_idx int")
    for n in (1, 7, 30, 1000):
        got = {(r.session_id, r.msg_idx): r.context for r in context.contexts(context.rendered(df), at, n, stride=4).collect()}
        want = {}
        for s, m in {(r.session_id, r.msg_idx) for r in at.collect()}:
            parts = [f"[user] {c or ''}" for (x, i, j, _, t, _, c, _) in sorted(rows, key=lambda r: r[1:3]) if x == s and i < m and t == "text"]
            want[s, m] = "\n".join(parts)[-n:]
        assert got == want, n


def test_entities_and_secrets(spark):
    df = blocks(spark, BASIC)
    pos = positions(df).withColumn("sid", F.col("sid"))
    seen = names.first_seen(context.rendered(df, None, None, tagged=False))
    secret = names.secrets(pos, seen)
    got = {(r.key, r.entity) for r in secret.collect()}
    assert got == {("s:1:0", "src/x.py"), ("s:3:1", "barbaz")}
    cands = spark.createDataFrame([("s:3:1", 0, "rename fooBar"), ("s:3:1", 1, "use BarBaz and BarBaz"), ("zz", 0, "BarBaz"), ("s:3:1", 2, None)], "key string, cand_idx int, r string")
    leak = {(r.key, r.cand_idx): r.leak for r in names.leaks(cands, secret).collect()}
    assert leak == {("s:3:1", 0): [], ("s:3:1", 1): ["barbaz"], ("zz", 0): [], ("s:3:1", 2): []}
    text = "读 foo_bar 中x_y 行  123 src/中.py tool_use Line 3 line 45 a.b.tsx PascalCase"
    e = set(spark.range(1).select(entities(F.lit(text)).alias("e")).first().e)
    assert {"foo_bar", "行  123", "line 45", "a.b.tsx", "pascalcase"} <= e and "tool_use" not in e


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(strip_ws(F.lit("　 a b\t\n"))) == "a b"
    assert [one(norm_number(F.lit(x))) for x in ("26,999", "2.50B", "1.2k", "44%", "867M", "n/a")] == [26999.0, 2.5e9, 1200.0, 44.0, 8.67e8, None]
    assert one(agrees(F.lit(100.0), F.lit(100.9), F.lit(0.01))) and not one(agrees(F.lit(100.0), F.lit(101.5), F.lit(0.01))) and not one(agrees(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.1)))
    assert one(parse_candidates(F.lit("short### a long enough\ncandidate ###"))) == ["a long enough candidate"]
    assert one(parse_candidates(F.lit(None).cast("string"))) == []


SCORES = [
    ("a", 0.0, [("x", 1.0, -1.0, []), ("y", 3.0, None, ["k"]), ("z", 1.0, -3.0, None)]), ("b", 0.0, [("x", 1.0, 0.0, ["k"])]), ("c", None, []), ("d", 0.0, None), ("e", 0.0, [("n", None, None, None), ("m", -2.0, 0.0, [])]),
]
SCORE = "key string, base double, results array<struct<r string, s_suff double, s_nat double, leak array<string>>>"


def test_selection(spark):
    s = candidates.long_scores(spark.createDataFrame(SCORES, SCORE))
    assert {(r.key, r.r) for r in selection.best_of_group(s).collect()} == {("a", "x"), ("e", "m")}
    assert tuple(selection.funnel(s).first()) == (3, 2, 1, 2)
    assert {(r.key, r.cand_idx) for r in selection.dual_verdict(s).filter("passed").collect()} == {("a", 0), ("b", 0)}
    empty = candidates.long_scores(spark.createDataFrame([], SCORE))
    assert tuple(selection.funnel(empty).first()) == (0, 0, 0, 0)
    assert selection.best_minus_single(empty).first().gain is None


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 2, 9, 9, 9, 3, 4, 100)] + [(None,)], "v double")
    vals = sorted([5, 1, 1, 2, 9, 9, 9, 3, 4, 100])
    q = {r.q: r.value for r in stats.index_quantiles(df, "v").collect()}
    assert q == {p: float(vals[int(10 * p)]) for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    assert stats.index_quantiles(df.filter("v IS NULL"), "v").count() == 0
    assert {r.q: r.value for r in stats.index_quantiles(df.filter("v = 9"), "v").collect()}[0.9] == 9.0
    assert stats.medians(df, ["v"]).first()[0] == 4.5
    h = spark.createDataFrame([(-20.0,), (20.0,), (19.9,), (21.0,), (None,)], "v double")
    assert {(r.bin, r.n) for r in stats.histogram(h, "v", -20, 20, 20).collect()} == {(0, 1), (19, 2)}
    assert df.filter("false").agg(stats.perplexity(F.col("v"), F.col("v"))).first()[0] == 1.0


def test_cohort(spark):
    w = spark.createDataFrame([(f"k{i}",) for i in range(50)] + [(None,)], "key string")
    done = cohort.pending(w, w.limit(0))
    assert cohort.pending(w.dropna(), w).isEmpty() and done.count() == 51
    shards = [w.dropna().filter(cohort.in_shard(F.col("key"), i, 3)).count() for i in range(3)]
    assert sum(shards) == 50 and max(shards) < 50


def test_arms(spark):
    rows = BASIC + [("s", 5, 0, "assistant", "thinking", None, "ok", None), ("s", 5, 1, "assistant", "tool_use", "Bash", None, "{}")]
    b = blocks(spark, rows)
    best = spark.createDataFrame([("s:3:1", "chosen")], "key string, r string")
    cand = spark.createDataFrame([("s:3:1", ["first"], "p"), ("s:1:0", ["unused"], "p")], "key string, candidates array<string>, provider string")
    a = arms.arm_blocks(b, best, cand)
    n = {r.arm: (r.n_blocks, r.n_thinking, r.n_filled) for r in arms.arm_counts(a).collect()}
    assert n["B"] == (10, 3, 0) and n["B_minus"] == (7, 0, 0) and n["R"] == (10, 3, 1) and n["R_dense"] == (10, 3, 1)
    assert a.filter("arm = 'R' AND block_idx = -1").first().content == "chosen"


def test_turns_alternate(spark):
    b = blocks(spark, BASIC)
    t = arms.merged_turns(arms.block_turns(b), "session_id").orderBy("turn").collect()
    assert all(x.who != y.who for x, y in zip(t, t[1:])) and t[0].who == "human"
    first = blocks(spark, BASIC[1:4])
    t = arms.merged_turns(arms.block_turns(first), "session_id").orderBy("turn").collect()
    assert [x.who for x in t] == ["human", "gpt"] and "<thinking>\nlate thought\n</thinking>" in t[1].value


def test_arms_keep_apart_and_have_their_system_text(spark):
    b = blocks(spark, BASIC)
    both = b.withColumn("arm", F.lit("B")).unionByName(b.filter("type <> 'thinking'").withColumn("arm", F.lit("B_minus")))
    records = spark.createDataFrame([("B", "s", '[{"text": "one"}, {"type": "x"}, "no", {"text": "two"}]'), ("B_minus", "s", "[1] plain [2]"), ("B", "u", "y" * 9000), ("B", "v", None)], "arm string, session_id string, system string")
    t = arms.with_system(arms.merged_turns(arms.block_turns(both), "arm", "session_id"), records, "arm", "session_id").collect()
    assert {(r.arm, r.session_id): r.value for r in t if r.turn == -1} == {("B", "s"): "one\n\ntwo", ("B_minus", "s"): "[1] plain [2]", ("B", "u"): "y" * 8000, ("B", "v"): ""}
    shown = {a: "".join(r.value for r in t if r.arm == a and r.turn >= 0) for a in ("B", "B_minus")}
    assert shown["B"].count("late thought") == 1 and "late thought" not in shown["B_minus"] and shown["B_minus"].count("please fix") == 1


def test_strip_and_insert(spark):
    kind = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))
    df = spark.createDataFrame([([("thinking", "a"), ("text", "b")],)], T.StructType([T.StructField("b", kind)]))
    r = df.select(arms.strip_thinking(F.col("b")).alias("s"), arms.insert_thinking(F.col("b"), F.struct(F.lit("thinking").alias("type"), F.lit("new").alias("text"))).alias("i")).first()
    assert [x.type for x in r.s] == ["text"] and [x.text for x in r.i] == ["new", "b"]


def test_stand_in_and_controls(spark):
    import math

    got = scoring.stand_in(10)(spark.createDataFrame([("a b a", "a c"), ("", ""), (None, None)], "prefix string, target string")).collect()
    assert abs(got[0].logprob - (math.log(3 / 13) + math.log(1 / 13))) < 1e-12 and got[0].n_tok == 2 and got[1].n_tok == 0 and got[2].logprob == 0
    a = spark.createDataFrame([(f"s{i}:{j}", f"s{i}", j, 0, f"t{i}.{j}") for i in range(7) for j in range(2)], "key string, sid string, msg_idx int, block_idx int, real_thinking_summary string")
    for size in (100, 2):
        m = scoring.mismatched(a, bucket_sessions=size).collect()
        assert len(m) == 14 and all(r.other and r.other.split(".")[0] != r.real_thinking_summary.split(".")[0] for r in m)
    one = a.filter("sid = 's1'")
    assert {r.other for r in scoring.mismatched(one).collect()} == {None}
    assert {(r.key, r.future) for r in scoring.with_future(one).collect()} == {("s1:0", "t1.1")}


def test_density(spark):
    d = {r.place: r for r in evaluation.density(blocks(spark, BASIC)).collect()}
    assert d["last"].turns == 1 and d["last"].thinking_blocks == 0 and d["second_last"].empty_blocks == 1 and d["3rd_to_5th"].nonempty_per_100_turns == 100.0


def test_audit(spark):
    docs = spark.createDataFrame([(1, "| 26,999 | sessions | `a.json` |\n|---|---|---|\n| none | x | y |\ntext 5"), (2, None), (3, "# 7\nx = 42 + y2\n\n")], "doc_id long, text string")
    assert [tuple(r) for r in audit.table_rows(docs, "doc_id", "text").collect()] == [(1, 0, "26,999", "sessions", "a.json")]
    assert [tuple(r) for r in audit.number_literals(docs, "doc_id", "text", ["5"]).filter("doc_id = 3").collect()] == [(3, 1, "42")]
    tex = spark.createDataFrame([("\\cite{a,b} \\citep{c}",)], "text string")
    bib = spark.createDataFrame([("@article{a, title={x}, journal={J}, year={2020}}\n@misc{b, eprint={2313.01234}, note={arXiv}}\n@misc{z, title={q}}\n",)], "text string")
    cited, entries = audit.cited_keys(tex, "text"), audit.bib_entries(bib, "text")
    assert [r[0] for r in audit.undefined_citations(cited, entries).collect()] == ["c"]
    assert [r[0] for r in audit.uncited_entries(cited, entries).collect()] == ["z"] and [r[0] for r in audit.unverifiable_entries(entries).collect()] == ["z"]
    assert [r.arxiv for r in audit.impossible_arxiv(entries).collect()] == ["2313.01234"]
    claims = spark.createDataFrame([("n", "10", 0.01), ("p", "44.0%", 0.01), ("m", "3", 0.01)], "claim string, stated string, tolerance double")
    metrics = spark.createDataFrame([("n", 10.05), ("p", 44.2)], "claim string, value double")
    assert {r.claim: r.verdict for r in audit.verify_claims(claims, metrics).collect()} == {"n": "differs", "p": "ok", "m": "missing"}
    files = spark.createDataFrame([("a.json", 3)], "path string, length long")
    rows = spark.createDataFrame([("x", "a.json"), ("y", "gone.json")], "claim string, source string")
    assert [r.claim for r in audit.missing_sources(rows, files).collect()] == ["y"]
    counts = spark.createDataFrame([("a", 100), ("b", 90)], "source string, n long")
    want = spark.createDataFrame([("a", 102), ("b", 100), ("c", 1)], "source string, expected long")
    assert {r.source for r in audit.sample_sizes(counts, want).collect()} == {"b", "c"}


def test_figures_and_documents(spark, tmp_path):
    from trailbed.sources.records import read_document

    figs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "stem string")
    prov = spark.createDataFrame([("a", None, "x.json", None, None, None), ("b", "screenshot", None, "u", None, None), ("c", "schematic", None, None, None, None)], "stem string, kind string, source string, source_url string, captured string, command string")
    assert {(r.stem, r.reason) for r in audit.unproven_figures(figs, prov).collect()} == {("b", "no address or date"), ("d", "no provenance")}
    (tmp_path / "d.json").write_text('{"a": {\n "b": [1, 2]}}')
    assert read_document(spark, str(tmp_path / "d.json")).first().a.b == [1, 2]
