import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailbed.operators.flatten import found_rows, session_groups, session_tables, triples


def walk(x, p=""):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from walk(v, f"{p}.{k}" if p else k)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from walk(v, f"{p}[{i}]")
    else:
        yield p or "$"


def brute(rows):
    def bad(_):
        raise ValueError

    out = set()
    for n, raw in rows:
        try:
            o = json.loads(raw or "", parse_constant=bad)
        except ValueError:
            continue
        for i, m in enumerate(o.get("messages") or [] if isinstance(o, dict) and isinstance(o.get("messages"), list) else []):
            out.add((n, i, -1, -1, ""))
            for j, b in enumerate(m["content"] if isinstance(m, dict) and isinstance(m.get("content"), list) else []):
                if not isinstance(b, dict):
                    continue
                out.add((n, i, j, -1, ""))
                if b.get("type") == "tool_result" and isinstance(b.get("content"), list):
                    out |= {(n, i, j, k, "") for k, x in enumerate(b["content"]) if isinstance(x, dict)}
                if b.get("type") == "tool_use" and "input" in b:
                    out |= {(n, i, j, -1, p) for p in walk(b["input"])}
    return out


ROWS = [
    (1, '{"messages":[{"role":"user","content":"hi"},3,null,{"content":[{"type":"text","text":"a"},"s",[{"x":1}],{"input":{"a":{"b":[{"c":1},{}]},"d":null,"e":[]},"type":"tool_use"}]}]}'),
    (2, '{"messages":[{"content":[{"type":"tool_result","content":[{"text":"x"},7,{"text":null}]},{"type":"other","content":[{"text":"x"}],"input":{"q":1}},{"type":"tool_use","input":"bare"},{"type":"tool_use","input":null},{"type":"tool_use","input":[1,{"a":2}]},{"type":"tool_use","input":{}}]}]}'),
    (3, '{"messages":[]} x'), (4, '[{"messages":[1]}]'), (5, '{"messages":[{"content":NaN}]}'), (6, '{"messages":[1,]}'), (7, ""), (8, None), (9, '{"messages":null,"z":{"messages":[1]}}'),
    (10, ' {"\\u006dessages" : [ {"content":[{"type":"tool_use","input":{"\\ud83d\\ude00 k":"\\ud83d","a.b":{"[x]":1}}}]} ] } '), (11, '{"messages":[{"a":01}]}'), (12, '{"a":1}{"b":2}'),
    (13, '{"messages":[{"content":[{"type":"text","type":"tool_use","input":{"a":1},"input":{"b":2}}]}]}'), (14, '{"messages":{"content":[1]}}'),
]


def test_found_matches_brute_force(spark):
    rows = ROWS + [(n + 100, r) for n, r in ROWS[:2]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "line_no long, raw string, id string")
    got = [tuple(r) for r in found_rows(session_groups(df)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_children_link_to_parents(spark):
    df = spark.createDataFrame(ROWS, "line_no long, raw string")
    t = session_tables(session_groups(df))
    blocks, parts, inputs = t["blocks"], t["parts"], t["inputs"]
    assert parts.join(blocks, ["id", "msg_idx", "block_idx"], "left_anti").isEmpty()
    assert inputs.join(blocks, ["id", "msg_idx", "block_idx"], "left_anti").isEmpty()
    assert blocks.join(t["messages"], ["id", "msg_idx"], "left_anti").isEmpty()
    assert {(r.path, r.value) for r in inputs.filter("id = 1").collect()} == {("a.b[0].c", "1"), ("d", None)}
    assert [r.content for r in t["messages"].filter("id = 1").orderBy("msg_idx").collect()] == ["hi", None, None, None]


def test_empty_table(spark):
    assert found_rows(session_groups(spark.createDataFrame([], "line_no long, raw string"))).isEmpty()


def test_deep_nesting_does_not_recurse():
    deep = '{"a":' + "[" * 5000 + "1" + "]" * 5000 + "}"
    assert len(triples(deep)) == 5002
    assert triples("[" * 100_000) is None


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(), c, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(), values, max_size=4), st.booleans())
def test_triples_agree_with_json(obj, ascii_):
    found = triples(json.dumps(obj, ensure_ascii=ascii_))
    assert sum(k not in ("object", "array") for _, _, k, _ in found) == sum(1 for v in obj.values() for _ in walk(v))


@pytest.mark.parametrize("raw", ['{"a":1', '{"a" 1}', "{,}", '{"a":tru}', '{"a":"\t"}', '{"a":"\\x"}', '{"a":1}}', "{}{}", '{"a":.5}', '{"a":+1}', "null", '"x"', '{1:2}', '{"a":1,}'])
def test_malformed(raw):
    assert triples(raw) is None


def test_no_member_is_lost(spark):
    """Every leaf of a record, and every empty container, is in a column of a table, in the inputs or among the members."""
    raw = '{"session_id":"s","meta":{"v":1,"none":{},"l":[1,{"a":"b"}]},"system":[{"type":"text","text":"t","x":true},"bare"],"tools":[{"name":"R","schema":{"p":{}}}],"messages":[{"role":"user","content":[{"type":"image","source":{"kind":"b64","data":"d"},"input":{"q":1}},{"type":"tool_use","id":"i","input":{"q":2},"extra":null},{"type":"tool_result","content":[{"type":"image","source":{"data":"e"}},"s"]}],"usage":{"in":1}}]}'
    t = session_tables(session_groups(spark.createDataFrame([(1, raw)], "line_no long, raw string")))
    assert [tuple(r) for r in t["sessions"].collect()] == [(1, "s", None)]
    assert [tuple(r) for r in t["system"].collect()] == [(1, 0, "text", "t")] and [tuple(r) for r in t["tools"].collect()] == [(1, 0, "R")]
    got = {(r.grp, tuple(r.ords), r.path, r.value) for r in t["members"].collect() if r.kind not in ("object", "array")}
    block = "messages[].content[]"
    assert got == {
        ("", (), "meta.v", "1"), ("meta.l[]", (0,), "", "1"), ("meta.l[]", (1,), "a", "b"), ("system[]", (0,), "x", "true"), ("system[]", (1,), "", "bare"),
        ("messages[]", (0,), "usage.in", "1"), (block, (0, 0), "source.kind", "b64"), (block, (0, 0), "source.data", "d"), (block + ".input", (0, 0), "q", "1"),
        (block, (0, 1), "extra", None), (block + ".content[]", (0, 2, 0), "source.data", "e"), (block + ".content[]", (0, 2, 1), "", "s"),
    }
    empty = {(r.grp, r.path) for r in t["members"].filter("kind IN ('object', 'array')").collect()}
    assert {("", "meta.none"), ("tools[]", "schema.p")} <= empty
