"""Deeply nested JSON records as related flat tables (problem 4).

Method: each record is stream-parsed into path-value-ordinal triples; paths are grouped by their
repeated ancestor (the innermost array element around them); each group is pivoted into one table
whose key is the record's id and the ordinals on the way down, so a child's key begins with its parent's.

The parse is strict JSON and uses no recursion. All triples of a record come from one row, so groups are
formed where the record is parsed and nothing is shuffled: a group's row leaves with its members as a map,
which Spark projects into columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailbed.session import spread

_TOKEN = re.compile(
    r"[ \t\n\r]*+(?:([{}\[\],:])"
    r'|("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null))"
)
_BLANK = re.compile(r"[ \t\n\r]*+")


def _text(token: str) -> str:
    if "\\" not in token:
        return token[1:-1]
    s = json.loads(token)
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if "\\u" in token else s


class _Frame:
    __slots__ = ("key", "n", "obj", "pattern", "seen", "start")

    def __init__(self, obj: bool, pattern: str, start: int):
        self.obj, self.pattern, self.start = obj, pattern, start
        self.key, self.n, self.seen = "", -1, {}


def _no_constant(name: str) -> None:
    raise ValueError(name)


_scan = json.JSONDecoder(parse_constant=_no_constant).scan_once


def _pass_by(raw: str, at: int) -> int | None:
    """The end of a well-formed container that begins at ``at``; None where it must be read by steps (broken, or nested too deep)."""
    try:
        return _scan(raw, at)[1]
    except (ValueError, StopIteration, RecursionError):
        return None


def triples(raw: str, enter: Callable[[str], bool] | None = None) -> list[tuple[str, tuple[str | int, ...], str, str | None]] | None:
    """(pattern, steps, kind, value) of every value of a JSON object, containers before their contents.

    ``enter`` tells by its pattern whether a container's contents are wanted; others are only checked to be well-formed.

    The pattern has members joined by dots and [] for array elements; in it dots, brackets and backslashes of names are
    escaped. Steps are the member names and ordinals themselves. A member given twice in one object counts once, the
    last. None if ``raw`` is not exactly one well-formed object.
    """
    out: list = []
    frames: list[_Frame] = []
    at, state = 0, "value"
    while True:
        m = _TOKEN.match(raw, at)
        if not m:
            return None
        at = m.end()
        mark, string, atom = m.groups()
        top = frames[-1] if frames else None
        if state in ("value", "first") and (string is not None or atom is not None or mark in ("{", "[")):
            if top is None:
                if mark != "{":
                    return None
                pattern = ""
            elif top.obj:
                if state == "first":
                    if string is None:
                        return None
                    state = _name(top, string, out)
                    continue
                pattern = top.pattern + "." + top.key if top.pattern else top.key
            else:
                top.n += 1
                pattern = top.pattern + "[]"
            begin = len(out)
            if mark:
                out.append((pattern, _steps(frames), "object" if mark == "{" else "array", None))
                if enter is not None and top is not None and not enter(pattern) and (past := _pass_by(raw, m.start(1))) is not None:
                    at, state = past, "next"
                    continue
                frames.append(_Frame(mark == "{", pattern, begin))
                state = "first"
                continue
            if string is not None:
                out.append((pattern, _steps(frames), "string", _text(string)))
            else:
                out.append((pattern, _steps(frames), "null" if atom == "null" else "boolean" if atom in ("true", "false") else "number", None if atom == "null" else atom))
            state = "next"
        elif state == "name" and string is not None:
            state = _name(top, string, out)
        elif state == "colon" and mark == ":":
            state = "value"
        elif state == "next" and mark == ",":
            state = "name" if top.obj else "value"
        elif state in ("next", "first") and mark == ("}" if top and top.obj else "]") and top:
            frames.pop()
            if top.obj and len(top.seen) and any(isinstance(v, list) for v in top.seen.values()):
                _drop_repeated(top, out)
            if not frames:
                return out if _BLANK.match(raw, at).end() == len(raw) else None
            state = "next"
        else:
            return None


def _name(frame: _Frame, token: str, out: list) -> str:
    name = _text(token)
    here = len(out)
    if name in frame.seen:
        old = frame.seen[name]
        frame.seen[name] = [*(old if isinstance(old, list) else [old]), here]
    else:
        frame.seen[name] = here
    frame.n = -1
    frame.key = re.sub(r"([\\.\[\]])", r"\\\1", name)
    return "colon"


def _drop_repeated(frame: _Frame, out: list) -> None:
    """Keep the last of members given more than once; ``seen`` holds where each occurrence begins."""
    begins = sorted(b for v in frame.seen.values() for b in (v if isinstance(v, list) else [v]))
    stale = {b for v in frame.seen.values() if isinstance(v, list) for b in v[:-1]}
    kept = out[: begins[0]]
    for b, e in zip(begins, [*begins[1:], len(out)], strict=True):
        if b not in stale:
            kept += out[b:e]
    out[:] = kept


def _steps(frames: list[_Frame]) -> tuple[str | int, ...]:
    return tuple(f.key if f.obj else f.n for f in frames)


def _shown(steps: Sequence[str | int]) -> str:
    """Names joined by dots, ordinals as [i]; $ for no steps at all."""
    s = ""
    for x in steps:
        if isinstance(x, int):
            s += f"[{x}]"
        else:
            name = re.sub(r"\\(.)", r"\1", x)
            s += f".{name}" if s else name
    return s or "$"


FLAT = "id long, grp string, ords array<int>, kind string, vals map<string,string>, kinds map<string,string>, up map<string,string>, path string, value string"


def _opening(groups: frozenset[str]) -> Callable[[str], bool]:
    """Whether a container lies on the way to one of the groups, or within it."""

    open_groups = [g for g in groups if g and not g.endswith("[]")]  # all below them is wanted, of an element only its own members

    @lru_cache(maxsize=1 << 16)
    def enter(pattern: str) -> bool:
        return any(g == pattern or g.startswith((pattern + ".", pattern + "[")) for g in groups) or any(pattern.startswith((g + ".", g + "[")) for g in open_groups)

    return enter


@lru_cache(maxsize=1 << 16)
def _place(pattern: str, open_paths: frozenset[str]) -> tuple[str | None, int, str, str]:
    """(open path around a pattern, its number of steps, the group, the rest of the pattern below the group's element)."""
    inside = next((p for p in open_paths if pattern == p or (pattern.startswith(p) and pattern[len(p)] in ".[")), None)
    depth = len(re.findall(r"(?<!\\)\[\]|(?<!\\)\.", inside)) + 1 if inside is not None else 0
    cut = pattern.rfind("[]")
    while cut > 0 and pattern[cut - 1] == "\\":
        cut = pattern.rfind("[]", 0, cut)
    grp, rel = (pattern[: cut + 2], pattern[cut + 2 :].lstrip(".")) if cut >= 0 else ("", pattern)
    return inside, depth, grp, rel


def group(found: list, open_paths: frozenset[str], carry: tuple[str, ...], only: frozenset[str] | None = None) -> list[tuple]:
    """Rows (grp, ords, kind, vals, kinds, up, path, value) of one record's triples.

    A row per array element and one for the record (grp ''), and below each of ``open_paths`` a row per scalar, with its path.
    ``only`` names the groups whose rows are wanted.
    """
    rows: dict[tuple[str, tuple[int, ...]], list] = {}
    free: dict[tuple, tuple] = {}
    for pattern, steps, kind, value in found:
        inside, depth, grp, rel = _place(pattern, open_paths)
        nested = kind in ("object", "array")
        if inside is not None and not (pattern == inside and nested):
            if not nested:
                ords = tuple(x for x in steps[:depth] if isinstance(x, int))
                free[inside, ords, _shown(steps[depth:])] = (kind, value)
            continue
        ords = tuple(x for x in steps if isinstance(x, int))
        if not rel:
            rows[grp, ords] = [kind, {} if nested else {"": value}, {}]
        else:
            row = rows[grp, ords]
            row[2][rel] = kind
            if not nested:
                row[1][rel] = value
    out = []
    for (grp, ords), (kind, vals, kinds) in rows.items():
        if only is None or grp in only:
            outer = grp[:-2]
            cut = outer.rfind("[]")
            above = rows.get((outer[: cut + 2] if cut >= 0 else "", ords[:-1])) if grp else None
            out.append((grp, ords, kind, vals, kinds, {k: above[1].get(k) for k in carry} if above else {}, None, None))
    for (inside, ords, path), (kind, value) in free.items():
        if only is None or inside in only:
            cut = inside.rfind("[]")
            above = rows.get((inside[: cut + 2] if cut >= 0 else "", ords))
            out.append((inside, ords, kind, {}, {}, {k: above[1].get(k) for k in carry} if above else {}, path, value))
    return out


def _flatten(batches: Iterator[pd.DataFrame], open_paths: frozenset[str], carry: tuple[str, ...], only: frozenset[str] | None = None, keys: bool = False) -> Iterator[pd.DataFrame]:
    names = ["id", "grp", "ords", "kind", "vals", "kinds", "up", "path", "value"]
    enter = _opening(only) if only is not None else None
    for pdf in batches:
        out = []
        for i, raw in zip(pdf["id"].tolist(), pdf["raw"].tolist(), strict=True):
            found = triples(raw, enter)
            if found is not None and keys:
                out += [(i, g, o, k, {}, {}, u, p, None) for g, o, k, _, _, u, p, _ in group(found, open_paths, carry, only)]
            elif found is not None:
                out += [(i, *row) for row in group(found, open_paths, carry, only)]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)


def flatten_records(df: DataFrame, id_col: str, raw_col: str, open_paths: Sequence[str] = (), carry: Sequence[str] = (), only: Sequence[str] | None = None, keys: bool = False) -> DataFrame:
    """The groups of all records as one long table (see FLAT); ``table_of`` makes one table of a group.

    ``only`` names the groups wanted, all if None: what lies outside them is not read into triples. ``keys`` leaves values out.

    Null, broken and non-object records give nothing; equal records under different ids each count; rows without an id are
    dropped; nulls are kept with kind 'null'; an empty array or object is seen only in its owner's ``kinds``.
    """
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(raw_col).alias("raw")).dropna()
    only = None if only is None else frozenset(only)
    return spread(source).mapInPandas(lambda it: _flatten(it, frozenset(open_paths), tuple(carry), only, keys), FLAT)


def table_of(flat: DataFrame, grp: str, ordinals: Sequence[str], columns: dict[str, str] | None = None, where: Column | None = None) -> DataFrame:
    """One group as a flat table: id, its ordinals by name, and ``columns`` (name -> path within the element)."""
    rows = flat.filter(F.col("grp") == grp)
    if where is not None:
        rows = rows.filter(where)
    keys = [F.try_element_at("ords", F.lit(i + 1)).alias(n) for i, n in enumerate(ordinals)]
    return rows.select("id", *keys, *[F.col("vals")[p].alias(n) for n, p in (columns or {}).items()])


SYSTEM, TOOLS = "system[]", "tools[]"
MESSAGES, BLOCKS, PARTS = "messages[]", "messages[].content[]", "messages[].content[].content[]"
INPUT = "messages[].content[].input"


# The group each table comes from.
TABLES = {"sessions": "", "system": SYSTEM, "tools": TOOLS, "messages": MESSAGES, "blocks": BLOCKS, "parts": PARTS, "inputs": INPUT}


def session_groups(raw_sessions: DataFrame, only: Sequence[str] | None = None, keys: bool = False) -> DataFrame:
    """The groups of unparsed session lines (line_no, raw); ``only`` and ``keys`` as in ``flatten_records``."""
    return flatten_records(raw_sessions, "line_no", "raw", [INPUT], ["type", "role", "name"], only, keys)


def session_tables(flat: DataFrame) -> dict[str, DataFrame]:
    """sessions, system, tools, messages, blocks, parts and inputs of ``session_groups``, each with the key of its parent, and the members beside them."""
    is_object, kind = F.col("kind") == "object", F.col("up")["type"]
    key = ["msg_idx", "block_idx", "part_idx"]
    inputs = flat.filter((F.col("grp") == INPUT) & (kind == "tool_use")).select(
        "id", F.col("ords")[0].alias("msg_idx"), F.col("ords")[1].alias("block_idx"), "path", "kind", "value", F.col("up")["name"].alias("tool_name")
    )
    of_result = is_object & (kind == "tool_result")
    shapes = {  # group, ordinals, columns, and which of its elements are rows
        "sessions": ("", [], {"session_id": "session_id", "system": "system"}, None),
        "system": (SYSTEM, ["system_idx"], {"type": "type", "text": "text"}, is_object),
        "tools": (TOOLS, ["tool_idx"], {"name": "name"}, is_object),
        "messages": (MESSAGES, key[:1], {"role": "role", "content": "content"}, None),
        "blocks": (BLOCKS, key[:2], {"type": "type", "name": "name", "text": "text", "thinking": "thinking", "content": "content", "tool_use_id": "tool_use_id", "call_id": "id"}, is_object),
        "parts": (PARTS, key, {"type": "type", "text": "text"}, of_result),
    }
    return {n: table_of(flat, *shape) for n, shape in shapes.items()} | {"inputs": inputs, "members": _members(flat, shapes)}


def _members(flat: DataFrame, shapes: dict[str, tuple]) -> DataFrame:
    """(id, grp, ords, path, kind, value): every member that no other table of ``session_tables`` shows, whatever its name.

    ``grp`` and ``ords`` are the key of the element it belongs to, ``path`` the way from there (as in ``triples``; empty for an
    element that is no object itself). Strings in columns are left out; a column's value of another kind is here too, with
    its kind, and so is every object or array, so that empty ones and nulls are told from absent ones.
    """
    free = F.col("path").isNotNull()  # below INPUT; of a tool call it is in ``inputs``
    single = F.create_map(F.coalesce("path", F.lit("")), F.col("kind"))
    own = F.when(~free & F.col("kind").isin("object", "array"), F.col("kinds")).otherwise(single)
    shown = F.array().cast("array<string>")
    for grp, _, columns, where in shapes.values():
        at = (F.col("grp") == grp) & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
        shown = F.when(at, F.array(*[F.lit(c) for c in columns.values()])).otherwise(shown)
    rows = flat.filter(~(free & F.coalesce(F.col("up")["type"] == "tool_use", F.lit(False))))
    value = F.when(free, F.col("value")).otherwise(F.col("vals")[F.col("at")])
    each = rows.withColumn("shown", shown).select("id", "grp", "ords", "path", "value", "vals", "shown", F.explode(own).alias("at", "of"))
    each = each.filter(~((F.col("of") == "string") & F.array_contains("shown", F.col("at"))))
    return each.select("id", "grp", "ords", F.col("at").alias("path"), F.col("of").alias("kind"), value.alias("value"))


def found_rows(flat: DataFrame) -> DataFrame:
    """The keys of all messages, blocks, parts and inputs of ``session_tables`` in one pass: (line_no, msg_idx, block_idx, part_idx, path), unused ones -1 or ''."""
    is_object, kind, grp = F.col("kind") == "object", F.col("up")["type"], F.col("grp")
    wanted = (
        (grp == MESSAGES)
        | ((grp == BLOCKS) & is_object)
        | ((grp == PARTS) & is_object & (kind == "tool_result"))
        | ((grp == INPUT) & (kind == "tool_use"))
    )
    ordinal = [F.coalesce(F.try_element_at("ords", F.lit(i + 1)), F.lit(-1)).alias(n) for i, n in enumerate(("msg_idx", "block_idx", "part_idx"))]
    return flat.filter(wanted).select(F.col("id").alias("line_no"), *ordinal, F.coalesce("path", F.lit("")).alias("path"))
