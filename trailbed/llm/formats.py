"""Configuration and code read into entries: a key path, a value, and where the value stands.

One forward pass over the lines of a text keeps the INI or TOML section, the open mappings of YAML (by indentation) and of
object literals (by braces). Values are read by the rules of their format: quoted with escapes, triple-quoted, block
scalars, shell words, and bare ones that end at a comma or bracket only where a bracket is open. Elements of XML, URLs,
headers, options of commands and netrc are read by grammars of their own (``credentials``).

JSON has a reader of its own with offsets into the raw text and its escapes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Entry(NamedTuple):
    path: str  # section, open mappings and key, joined by dots
    key: str
    begin: int  # of the value, in characters
    end: int
    quoted: bool
    sign: str  # what stands between key and value


_SECTION = re.compile(r"[ \t]*\[\[?[ \t]*([\w.\-\"' ]+?)[ \t]*\]?\][ \t]*(?:[#;].*)?$")
_KEY = re.compile(
    r"""(?P<kq>["'`]?)(?<![\w.\-])(?P<key>[^\W\d][\w.\-]*)(?P=kq)\]?(?P<sign>[ \t]*(?::=|=>|->|=|:|：)(?!=)[ \t]*(?:(?:Bearer|Basic|Token|token|bearer|basic|Digest|ApiKey)[ \t]+)?)"""
)
_OPENS = re.compile(r"""[ \t]*(?:-[ \t]+)?["']?([\w.\-]+)["']?[ \t]*(?::|=)[ \t]*[{\[(]?[ \t]*$""")
_TRIPLE = re.compile(r'[rbfuRBFU]{0,2}("""|\'\'\')')
_QUOTED = re.compile(r"""[rbfuRBFU@$]{0,2}(?:"(?P<dq>(?:[^"\\\n]|\\.)*)"|'(?P<sq>(?:[^'\\\n]|\\.)*)'|`(?P<bq>[^`\n]*)`)""")
_BLOCK = re.compile(r"(?:!!\w+[ \t]+)?[|>][+\-]?\d?[+\-]?[ \t]*(?:#.*)?$")
_TAG = re.compile(r"!\w[\w.\-]*(?=[ \t]|$)")
_WORD = re.compile(r"""[^\s"'`]+""")
_STOP = re.compile(r"[，。；、]|\\n|&(?=[A-Za-z_]\w*=)|;(?=[ \t]*[A-Za-z][\w \t]*=)|</|(?<=.)[<>](?=[/\w])")
_CLOSE = {")": "(", "]": "[", "}": "{"}


def _bare_end(text: str, begin: int, end: int, inside: bool) -> int:
    """Where a bare word ends: at a sign that separates members, and before punctuation that closes what is around it."""
    if m := _STOP.search(text, begin, end):
        end = m.start()
    open_: list[str] = []
    for i in range(begin, end):
        c = text[i]
        if c in "([{":
            open_.append(c)
        elif c in ")]}":
            if open_ and open_[-1] == _CLOSE[c]:
                open_.pop()
            elif inside:
                end = i
                break
        elif c == "," and inside and not open_:
            end = i
            break
    spare = {c: text.count(c, begin, end) - text.count(o, begin, end) for c, o in _CLOSE.items()}
    while end > begin and ((c := text[end - 1]) in ",;\\:" or spare.get(c, 0) > 0):
        spare[c] = spare.get(c, 0) - 1
        end -= 1
    return end


def value_at(text: str, at: int, line_end: int, inside: bool, indent: int = 0, at_line: bool = False) -> tuple[int, int, bool] | None:
    """(begin, end, quoted) of the value that begins at ``at``; None if there is none.

    ``inside`` says that a bracket is open on the line, ``at_line`` that the key opens its line, so the value may run on.
    """
    if at >= line_end:
        return None
    if m := _TRIPLE.match(text, at):
        stop = text.find(m.group(1), m.end())
        if stop < 0:
            return None
        begin = m.end() + (text[m.end() : m.end() + 1] == "\n")
        while stop > begin and text[stop - 1] in " \t\n":
            stop -= 1
        return begin, stop, True
    if m := _QUOTED.match(text, at, line_end):
        g = m.lastgroup
        return m.start(g), m.end(g), True
    if at_line and _BLOCK.match(text, at, line_end):
        return _block(text, line_end, indent)
    if at_line and _TAG.match(text, at, line_end):  # a YAML tag, as of a value kept in a vault
        return None
    if m := _WORD.match(text, at, line_end):
        return at, _bare_end(text, at, m.end(), inside), False
    return None


def _block(text: str, line_end: int, indent: int) -> tuple[int, int, bool] | None:
    """A block scalar: the lines below that are indented more, from their first sign to their last."""
    begin, end, at = -1, -1, line_end + 1
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        bare = line.lstrip(" \t")
        if bare:
            if len(line) - len(bare) <= indent:
                break
            begin = at + len(line) - len(bare) if begin < 0 else begin
            end = at + len(line.rstrip())
        at = stop + 1
    return (begin, end, True) if begin >= 0 else None


def entries(text: str) -> Iterator[Entry]:
    """Every key with a value in the order of the text; a value may itself hold entries."""
    section, stack, at, size = "", [], 0, len(text)
    while at <= size:
        end = text.find("\n", at)
        end = size if end < 0 else end
        begin = at
        at = end + 1
        i = begin
        while i < end and text[i] in " \t":
            i += 1
        if i == end:
            continue
        indent = i - begin
        while stack and stack[-1][0] >= indent and text[i] not in "}])":
            stack.pop()
        if text[i] == "[" and (m := _SECTION.match(text, begin, end)):
            section, stack = m.group(1).strip("\"' "), []
            continue
        braces: list[tuple[int, str]] = []  # objects opened on this line: depth and name
        depth, seen, first = 0, i, True
        for m in _KEY.finditer(text, i, end):
            for c in text[seen : m.start()]:
                if c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth = max(0, depth - 1)
            seen = m.start()
            while braces and braces[-1][0] > depth:
                braces.pop()
            lead = text[i : m.start()]
            at_line = first and (not lead or lead in ("- ", "export ", "set ", "ENV ", "const ", "let ", "var ") or lead.startswith(("- ", "export ")))
            first = False
            names = [section, *(n for _, n in stack), *(n for _, n in braces), m.group("key")]
            got = value_at(text, m.end(), end, depth > 0, indent, at_line)
            if got and got[1] > got[0]:
                yield Entry(".".join(n for n in names if n), m.group("key"), *got, m.group("sign"))
            if text[m.end() : m.end() + 1] in ("{", "["):
                braces.append((depth + 1, m.group("key")))
        if m := _OPENS.match(text, begin, end):
            stack.append((indent, m.group(1)))


class Scalar(NamedTuple):
    path: str
    begin: int  # inside the quotes
    end: int
    quoted: bool


_JSON = re.compile(r'[ \t\n\r]*+(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?\d[\d.eE+-]*|true|false|null))')
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_SIMPLE = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def unescape(body: str) -> tuple[str, list[int] | None]:
    """The string's text and, for each of its characters and the end, the offset in ``body``; None if they are the same."""
    if "\\" not in body:
        return body, None
    text, places, at = [], [], 0
    for m in _ESCAPE.finditer(body):
        text.append(body[at : m.start()])
        places += range(at, m.start())
        text.append(chr(int(m.group(1), 16)) if m.group(1) else _SIMPLE.get(m.group(2), m.group(2)))
        places.append(m.start())
        at = m.end()
    text.append(body[at:])
    places += range(at, len(body) + 1)
    return "".join(text), places


def json_scalars(raw: str) -> list[Scalar] | None:
    """Every scalar but null of a JSON text with its key path; None if malformed."""
    out, stack, at = [], [], 0
    while at < len(raw):
        m = _JSON.match(raw, at)
        if not m:
            return None if raw[at:].strip() else out
        at = m.end()
        mark, string, atom = m.groups()
        top = stack[-1] if stack else None
        if mark in ("{", "["):
            stack.append([mark, None, 0, True])
        elif mark in ("}", "]"):
            if not stack:
                return None
            stack.pop()
            if stack:
                stack[-1][3] = False
        elif mark == ":":
            if not top or top[0] != "{":
                return None
            top[3] = False
        elif mark == ",":
            if not top:
                return None
            top[2] += 1
            top[3] = True
        elif string is not None and top and top[0] == "{" and top[3]:
            top[1] = unescape(string[1:-1])[0]
        elif string is not None or atom != "null":
            path = ".".join(str(s[1]) if s[0] == "{" else f"[{s[2]}]" for s in stack)
            quoted = string is not None
            out.append(Scalar(path, m.start(2) + 1 if quoted else m.start(3), m.end(2) - 1 if quoted else m.end(3), quoted))
    return out if not stack else None
