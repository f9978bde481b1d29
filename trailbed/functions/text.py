"""Scalar expressions on text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that never count. Fixed values.
STOP_ENTITIES = ["tool_use", "tool_result", "assistant", "user_id", "session_id"]
# Kinds of action by tool name. Fixed values.
ACTION_KINDS = {
    "Read": "读取某个文件", "Grep": "搜索代码", "Glob": "按模式查找文件", "LS": "列出目录", "Edit": "修改某个文件", "Write": "写入某个文件", "MultiEdit": "批量修改某个文件",
    "NotebookEdit": "修改notebook", "Bash": "执行一条命令", "WebFetch": "查阅网络资料", "Agent": "派出子任务", "Task": "派出子任务", "TodoWrite": "更新任务清单",
}
OTHER_KIND = "调用某个工具"
# What counts as a name, in order: file paths by ending, snake_case, camelCase, PascalCase, line numbers. Fixed values.
ENTITY = (
    r"[A-Za-z0-9_\-./]+\.(?:py|js|ts|tsx|jsx|go|rs|java|rb|c|cc|cpp|h|hpp|json|yaml|yml|toml|cfg|ini|md|sh|sql|vue|css|html)\b"
    r"|\b[a-z_][a-z0-9_]*_[a-z0-9_]+\b|\b[a-z]+[A-Z][A-Za-z0-9]+\b|\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b|(?:line|行)\s*\d{2,}"
)


def strip_ws(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.length(strip_ws(F.coalesce(c, F.lit("")))) == 0


def entities(c: Column) -> Column:
    """Distinct lower-cased names in a text: paths, identifiers and line numbers. Null gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?U)" + ENTITY), F.lit(0))
    return F.array_except(F.array_distinct(F.transform(found, lambda x: F.lower(strip_ws(x)))), F.array(*map(F.lit, STOP_ENTITIES)))


def action_kind(name: Column) -> Column:
    """General phrase for a tool; unknown and missing tools get one phrase."""
    kinds = F.create_map(*[F.lit(x) for pair in ACTION_KINDS.items() for x in pair])
    return F.coalesce(kinds[name], F.lit(OTHER_KIND))


def position_key(sid: Column, msg_idx: Column, block_idx: Column) -> Column:
    return F.concat_ws(":", sid, msg_idx.cast("string"), block_idx.cast("string"))


def parent_key(key: Column) -> Column:
    """A key without its last component."""
    return F.regexp_replace(key, ":[^:]*$", "")


def parse_candidates(raw: Column, least: int = 15, cap: int = 600) -> Column:
    """Texts between ### marks: stripped, on one line, cut to ``cap`` characters, those under ``least`` dropped."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), "###"), strip_ws)
    return F.transform(F.filter(parts, lambda x: F.length(x) >= least), lambda x: F.left(F.regexp_replace(x, "\n", " "), F.lit(cap)))


def norm_number(c: Column) -> Column:
    """A number as written in prose: thousands separators, %, k, M and B."""
    text = F.regexp_replace(F.trim(c), r"[,\s+]", "")
    factor = F.when(text.rlike("[bB]$"), 1e9).when(text.rlike("M$"), 1e6).when(text.rlike("[kK]$"), 1e3).otherwise(1.0)
    return F.regexp_replace(text, "[%kKMbB]$", "").try_cast("double") * factor


def agrees(stated: Column, value: Column, tolerance: Column) -> Column:
    """Whether a stated number is within a relative tolerance of the recomputed one; a tolerance of 0 asks for equality."""
    return F.when(value.isNull() | stated.isNull(), F.lit(False)).when(tolerance == 0, stated == value).otherwise(F.abs(stated - value) <= tolerance * F.greatest(F.abs(stated), F.lit(1e-12)))


def differs_by(stated: Column, value: Column, most: Column) -> Column:
    """Whether a stated number is further than ``most`` from the recomputed one; null counts as further."""
    return F.coalesce(F.abs(stated - value) > most, F.lit(True))


def signed(c: Column, digits: int = 2) -> Column:
    """A number with its sign, also if positive."""
    return F.format_string(f"%+.{digits}f", c.cast("double"))


def thousands(c: Column) -> Column:
    """A whole number with commas between its thousands."""
    return F.format_number(c, 0)


def path_stem(c: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot is no suffix."""
    return F.regexp_extract(c, r"([^/]+?)([.][^./]+)?$", 1)


def path_suffix(c: Column) -> Column:
    """The last suffix of a path with its dot, empty if it has none."""
    return F.regexp_extract(c, r"([^/]+?)([.][^./]+)?$", 2)


def tex_plain(c: Column) -> Column:
    """Text without the names of TeX macros and braces, white space at the ends removed."""
    return strip_ws(F.regexp_replace(c, r"\\[A-Za-z]+|[{}]", ""))
