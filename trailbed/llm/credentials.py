"""Credentials in source, configuration and logs (problem 1).

Method: configuration formats are parsed into key paths with offsets (``formats``); key names are tested for being
sensitive and values for having the shape of a live secret; redactions are spliced into the original bytes.

Formats: JSON (strict, with offsets into the raw text and its escapes), INI, properties, dotenv, TOML, YAML with block
scalars, source code with object literals and call arguments, XML, connection strings, URLs (user info and query), HTTP
headers, netrc, command-line options, key blocks, and sentences that name a secret. Each gives entries: key path, value
and place. A token whose issuer's prefix gives it away needs no sensitive key; its path is that of the entry around it.

All work is per row: blocks are mapped over once and nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailbed.llm.formats import Entry, entries, json_scalars, unescape
from trailbed.session import spread


class Finding(NamedTuple):
    begin: int  # in characters of the text as stored
    end: int
    kind: str
    path: str
    bare: bool = False  # a JSON value without quotes, whose mark needs them


# Words that make a key sensitive, and words that take this back. Fixed values.
SENSITIVE = (
    "password passwd passphrase passcode pass pwd pw secret token jwt credential credentials apikey api_key access_key account_key secret_key "
    "private_key signing_key encryption_key master_key shared_key auth_key auth authorization private_token access_token auth_token api_token api_secret client_secret "
    "contraseña clave passwort kennwort 密码 口令 令牌 密钥 秘钥"
).split()
HARMLESS = "max_tokens token_count tokenizer tokens n_tokens secret_name token_type token_url auth_type auth_url auth_method password_field public_key key_id_type pass_rate".split()

# Prefixes by which issuers mark their tokens. Fixed values.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_-])(?:"
    r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|gh[pousr]_[A-Za-z0-9]{20,}"
    r"|github_pat_[A-Za-z0-9_]{22,}"
    r"|glpat-[A-Za-z0-9_-]{16,}"
    r"|AIza[A-Za-z0-9_-]{30,}"
    r"|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|hv[sb]\.[A-Za-z0-9_-]{20,}"
    r"|npm_[A-Za-z0-9]{20,}"
    r"|pypi-[A-Za-z0-9_-]{20,}"
    r"|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{10,}"
    r"|[a-z][a-z0-9]{1,9}_(?:live|test|prod|dev|stage|pat|sk|key|secret|token)_[A-Za-z0-9]{14,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]*)?"
    r")"
)
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----", re.S)

_VALUE = r"""(?:"(?P<dq>(?:[^"\\\n]|\\.)*)"|'(?P<sq>(?:[^'\\\n]|\\.)*)'|`(?P<bq>[^`\n]*)`|(?P<bare>[^\s"'`]+))"""
NAMED_CALL = re.compile(r"""\(\s*["'](?P<key>[\w.\-]{2,})["']\s*,\s*""" + _VALUE)
HEADER = re.compile(r"""(?<![\w\-])(?P<key>(?i:authorization|proxy-authorization|[\w-]*(?:api-?key|token|secret|auth)))["']?\]?[ \t]*[:=][ \t]*["']?(?:(?i:bearer|basic|token|digest|apikey)[ \t]+)?(?P<bare>[^\s"'`,;]+)""")
URL_USER = re.compile(r"""(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]*:(?:\\?/){2}(?P<key>[^\s:/@"'<>]*):(?P<bare>[^\s"'<>/]+|[^\s"'<>]+?)@(?=[\w.\[-])""")
URL_QUERY = re.compile(r"""[?&](?P<key>[\w\-]+)=(?P<bare>[^&\s"'#<>;]+)""")
XML_VALUE = re.compile(r"""<(?P<tag>[\w:.\-]+)(?:\s+(?:name|key|id)=["'](?P<name>[\w.\-]+)["'])?[^<>\n]*>(?P<bare>[^<>\n]+)</""")
XML_ATTRIBUTE = re.compile(r"""<[\w:.\-]+\s[^<>\n]*?\b(?:name|key|id)=["'](?P<key>[\w.\-]+)["'][^<>\n]*?\bvalue=["'](?P<bare>[^"'<>\n]+)["']""")
NETRC = re.compile(r"""\b(?P<key>password|passwd)[ \t]+(?P<bare>[^\s"']+)""")
NETRC_BEFORE = re.compile(r"\b(?:machine|login|account)[ \t]+\S+[ \t]+(?=pass)")
OPTION = re.compile(r"""(?<![\w-])--?(?P<key>[A-Za-z][\w\-]+)(?:=|[ \t]+)""" + _VALUE)
# A command, and the option of it that takes a secret (redis-cli -a x, mysql -px, sshpass -p x, curl -u name:x).
SHORT_OPTIONS = (
    (re.compile(r"\b(?:mysql|mysqldump|mariadb|mysqladmin)\b"), re.compile(r"[ \t](?P<key>-p)(?=[^\s])" + _VALUE)),
    (re.compile(r"\bredis-cli\b"), re.compile(r"[ \t](?P<key>-a)[ \t]+" + _VALUE)),
    (re.compile(r"\bsshpass\b"), re.compile(r"[ \t](?P<key>-p)[ \t]*" + _VALUE)),
    (re.compile(r"\b(?:curl|wget|http|https)\b"), re.compile(r"""[ \t](?P<key>-u|--user)[ \t]+["']?[^\s:"']*:""" + _VALUE)),
)
SAID = re.compile(
    r"""(?=[ptscak密口令])(?P<key>password|passphrase|passwd|pwd|token|secret|credential|api key|access key|contraseña|clave|Passwort|Kennwort|密码|口令|令牌|密钥)[ \t]*(?:,[ \t]*)?(?:the new one |für \S+ |for \S+ |de \S+ |von \S+ )?(?:is now|is|was|ist|lautet|es|为|是|换成|改成|：|:)[ \t]*""" + _VALUE, re.I
)
# A sentence in two parts: a word, and later on the same line or in the same sentence the secret.
LOGIN = (re.compile(r"\b(?i:login|log in|sign in|anmelden|user|usuario|account|svc_\w+)\b"), re.compile(r"""\b(?P<key>pass|password|passwd|pw|pwd|token|secret|Passwort|contraseña)[ \t]+""" + _VALUE))
SAID_NEW = (re.compile(r"(?i)token|password|key|secret"), re.compile(r"""(?i)\b(?P<key>new one|neue|nueva|nuevo)\b[ \t]*(?:is|ist|es|:)[ \t]*""" + _VALUE))
SAID_BEFORE = re.compile(r"""["'`](?P<bare>[^\s"'`]{6,})["'`][ \t]+(?:as|como|als|作为)[ \t]+(?:the[ \t]+|la[ \t]+|das[ \t]+)?(?P<key>password|passphrase|token|secret|api key|contraseña|clave|Passwort|密码|口令|令牌)""", re.I)


def _after(first: re.Pattern, then: re.Pattern, text: str, stops: str) -> Iterator[re.Match]:
    """Matches of ``then`` that follow one of ``first`` with none of the signs ``stops`` in between; linear in the text."""
    marks = [m.end() for m in first.finditer(text)]
    if not marks:
        return
    ends = [m.start() for m in re.finditer(stops, text)]
    for m in then.finditer(text):
        k = bisect_right(marks, m.start()) - 1
        if k >= 0 and bisect_right(ends, m.start() - 1) == bisect_right(ends, marks[k] - 1):
            yield m


def _hints() -> tuple[str, ...]:
    """What every finding needs, in lower case: the last part of a sensitive name, or a sign that one of the other grammars begins with."""
    words = {w.rsplit("_", 1)[-1] for w in SENSITIVE} | set("pw akia asia ghp_ gho_ ghu_ ghs_ ghr_ github_pat glpat aiza sk- xox hvs. hvb. npm_ pypi- _live_ _test_ _prod_ _dev_ _stage_ _pat_ _sk_ sk_ rk_ sg. eyj --user sig= signature= bearer ://".split())
    words |= {" -u", " -a", " -p"}
    return tuple(sorted(w for w in words if not any(v != w and v in w for v in words)))


_HINTS = _hints()


def hinted(text: str) -> bool:
    """Cheap test that lets texts pass by in which no grammar can find anything."""
    low = text.lower()
    return any(h in low for h in _HINTS)


_PLACE = re.compile(
    r"""(?ix)^(?:
      <.*>? | \$.* | !(?:vault|secret|ref|sub|env|getatt|include|reference|importvalue)\b.* | %\w+% | \{.* | \[.* | .*\{\{.* | \*+ | x{3,} | \.{2,} | -+ | _+ | \#+ | \?+ | …+
      | (?:my|your|the|some|a|an)?[-_ ]?(?:new[-_ ])?(?:super[-_ ]?)?(?:password|passwd|pass|secret|token|key|api[-_]?key|apikey|credentials?|value|user|username|pwd)(?:[-_ ]?(?:here|goes[-_ ]here|value|field|123))?
      | your.* | change[-_ ]?(?:me|it|this).* | replace[-_ ]?(?:me|this).* | insert.* | todo.* | fixme.* | redacted.* | masked.* | hidden | removed | example.* | sample.* | dummy.* | placeholder.* | none | null | nil | undefined | true | false | yes | no | on | off | empty | unset | n/?a | tbd
      | string | str | int | integer | number | bool | boolean | bytes | object | any | void | optional.* | required | char | text | varchar.*
    )$"""
)
_CODE = re.compile(r"^(?:os\.|process\.|env\.|ENV\[|config\.|settings\.|self\.|this\.|vault[.:/]|secrets?[.:/]|ssm:|arn:|getenv|getpass|input\(|await\b|new\b|lambda\b|function\b|def\b|return\b|import\b|kms:|op://|\w+\(|[\w.]+\[\D|file://|https?://|/[\w./-]+$|\.{0,2}/[\w./-]+$|[\w.@-]+(?:/[\w.@-]+)+\.[a-z]{1,5}\.?$|@)")
_NOT_SECRET = re.compile(r"^(?:sha\d+[:-].*|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|ssh-(?:rsa|ed25519|dss).*|data:.*|\d{1,5}|\d+(?:\.\d+)?(?:ms|s|m|h|d|kb|mb|gb|%)|v?\d+(?:\.\d+)+)$", re.I)
_TAGGED = re.compile(r"^<|<[\w \-]+>")
_WORDS = re.compile(r"^(?:[a-z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]+|[A-Z]+|[a-z]+(?:_[a-z]+)+|[A-Z]+(?:_[A-Z]+)+|[a-z]+(?:-[a-z]+)+|[a-z_]+(?:\.[a-z_]+)+)$")


@lru_cache(maxsize=1 << 16)
def sensitive_key(key: str) -> bool:
    """Whether the last name of a key path calls for a secret: its words, split at case and signs, end in a sensitive name."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", key).lower()
    words = re.sub(r"[^\w]+", "_", words).strip("_")
    if words in HARMLESS or any(words.endswith("_" + h) for h in HARMLESS):
        return False
    joined = words.replace("_", "")
    for s in SENSITIVE:
        if words == s or words.endswith("_" + s) or joined == s.replace("_", ""):
            return True
    return words.endswith(("apikey", "password", "passwd", "secret")) or words in ("secret_key_base", "aws_access_key_id", "access_key_id", "_pwd", "id_token", "refresh_token", "bearer")


def live_value(value: str, quoted: bool, after: str = "", strict: bool = False) -> bool:
    """Whether a value has the shape of a secret that could be used: no placeholder, reference, code, number, checksum or plain word.

    strict asks for more, where the key alone is weak evidence: a digit, sign or irregular case. A value of four signs needs a digit or sign among them, a shorter one is
    none. Letters beyond ASCII, < > and … inside are taken for part of a secret only within quotes and beside digits or signs.
    """
    if len(value) < 4 or _PLACE.match(value) or _NOT_SECRET.match(value) or any(c.isspace() for c in value):
        return False
    if set(value) <= set("*.-_xX#•…"):
        return False
    digits, signs = any(c.isdigit() for c in value), bool(re.search(r"[^\w]", value, re.A))
    letters = any(c.isalpha() for c in value)
    if len(value) == 4 and not (letters and (digits or signs)):
        return False
    if "***" in value or "${" in value or "$(" in value or "{{" in value or _TAGGED.search(value):
        return False
    odd = any(ord(c) > 126 for c in value)
    if odd and not (quoted and digits and letters and sum(c.isascii() for c in value) * 2 > len(value)):
        return False
    if ("<" in value or ">" in value) and not (quoted and digits):
        return False
    if "..." in value and not (quoted and digits and re.search(r"[!@#$%^&*+=~?]", value) and not value.startswith("...") and not value.endswith("...")):
        return False
    if _CODE.match(value) or (not quoted and after[:1] in ("(", "[")):
        return False
    if not quoted or strict:
        if _WORDS.match(value.rstrip(".!?:")):
            return False
        if not digits and not signs and not (re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value) and len(value) >= 8):
            return False
        if re.search(r"^\w*[(\[{]|[(\[{]\w*[)\]}]$", value):
            return False
    return True


def _clip(value: str) -> str:
    """A bare value without the punctuation that ends its sentence, argument or clause."""
    cut = re.search(r"[,;)\]}，。；、]|\\n|&(?=[a-z_]+=)", value)
    if cut:
        value = value[: cut.start()]
    return value.rstrip("\\").rstrip(":") if value[-1:] in ("\\", ":") else value


def _group(m: re.Match) -> tuple[int, int, bool]:
    for g in ("dq", "sq", "bq"):
        if g in m.re.groupindex and m.group(g) is not None:
            return m.start(g), m.end(g), True
    return m.start("bare"), m.start("bare") + len(_clip(m.group("bare"))), False


def _words(key: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key).lower()


def _of_entry(text: str, e: Entry) -> str | None:
    """The kind of secret an entry holds, None if it holds none."""
    value = text[e.begin : e.end]
    if not e.quoted and re.match(r"=[ \t]", e.sign):  # NAME= in a shell: an empty value
        return None
    words = _words(e.key)
    weak = words in ("auth", "token", "pass", "key", "clave", "secret")
    if not live_value(value, e.quoted, text[e.end : e.end + 1], weak) or (words == "auth" and e.quoted and not _encoded(value) and _WORDS.match(value)):
        return None
    return "encoded" if _encoded(value) else "password" if "pass" in words or "pwd" in words else "key"


def scan_text(text: str, path: str = "") -> list[Finding]:
    """Findings in one text; those inside others are dropped."""
    if not hinted(text):
        return []
    parsed = list(entries(text))
    begins = [e.begin for e in parsed]
    out: list[Finding] = []

    def around(at: int) -> str:
        """The path of the entry whose value holds a place."""
        k = bisect_right(begins, at) - 1
        return parsed[k].path if k >= 0 and at < parsed[k].end else ""

    def add(begin: int, end: int, kind: str, key: str) -> None:
        out.append(Finding(begin, end, kind, ".".join(x for x in (path, key) if x)))

    for e in parsed:
        if sensitive_key(e.key) and (kind := _of_entry(text, e)):
            add(e.begin, e.end, kind, e.path)
    for m in KEY_BLOCK.finditer(text):
        add(m.start(), m.end(), "private_key", around(m.start()))
    for m in ISSUED.finditer(text):
        add(m.start(), m.end(), "signed_token" if m.group().startswith("eyJ") else "access_key_id" if m.group()[:4] in ("AKIA", "ASIA") else "token", around(m.start()))

    def each(grammar: re.Pattern | Iterator[re.Match], kind: str, test, prefix: str = "") -> None:
        """Entries of one more grammar; ``test`` takes key, value, quoted and the text after it."""
        for m in grammar.finditer(text) if isinstance(grammar, re.Pattern) else grammar:
            begin, end, quoted = _group(m)
            key = m.groupdict().get("key") or ""
            if end > begin and test(m, key, text[begin:end], quoted, text[end : end + 1]):
                add(begin, end, "encoded" if kind == "key" and _encoded(text[begin:end]) else kind, ".".join(x for x in (around(m.start()), prefix, key) if x))

    each(URL_USER, "url_password", lambda m, k, v, q, a: live_value(v, True), "url")
    each(URL_QUERY, "url_parameter", lambda m, k, v, q, a: (sensitive_key(k) or k.lower() in ("key", "sig", "signature")) and live_value(v, False, strict=True), "url")
    each(NAMED_CALL, "key", lambda m, k, v, q, a: q and sensitive_key(k) and live_value(v, True))
    each(HEADER, "key", _header)
    each(XML_ATTRIBUTE, "password", lambda m, k, v, q, a: sensitive_key(k) and live_value(v, True))
    for m in XML_VALUE.finditer(text):
        if sensitive_key(m.group("name") or m.group("tag")) and live_value(m.group("bare"), True):
            add(m.start("bare"), m.end("bare"), "password", m.group("name") or m.group("tag"))
    logins = {m.end() for m in NETRC_BEFORE.finditer(text)}
    each(NETRC, "password", lambda m, k, v, q, a: m.start() in logins and live_value(v, True), "netrc")
    each(OPTION, "key", lambda m, k, v, q, a: sensitive_key(k) and live_value(v, q, strict=True), "option")
    for command, option in SHORT_OPTIONS:
        each(_after(command, option, text, r"[\n|;&]"), "password", lambda m, k, v, q, a: live_value(v, True), "option")
    for grammar in (SAID, _after(*LOGIN, text, r"\n"), _after(*SAID_NEW, text, r"[.\n]")):
        each(grammar, "password", lambda m, k, v, q, a: live_value(v, q, a, True), "said")
    each(SAID_BEFORE, "password", lambda m, k, v, q, a: live_value(v, True), "said")
    return _outermost(out)


def _header(m: re.Match, key: str, value: str, quoted: bool, after: str) -> bool:
    return live_value(value, False, after) and len(value) >= 8 and (key.lower().endswith("authorization") or "-" in key and sensitive_key(key))


def _encoded(value: str) -> bool:
    if len(value) < 12 or len(value) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value):
        return False
    try:
        return all(31 < b < 127 for b in base64.b64decode(value, validate=True))
    except ValueError:
        return False


def _outermost(found: list[Finding]) -> list[Finding]:
    """Findings in order of place, without those that overlap an earlier or longer one."""
    out: list[Finding] = []
    for f in sorted(found, key=lambda f: (f.begin, -f.end)):
        if f.end > f.begin and (not out or f.begin >= out[-1].end):
            out.append(f)
    return out


def scan_json(raw: str) -> list[Finding]:
    """Findings in a JSON text, offsets in the raw text with its escapes; text that is no JSON is scanned as it stands."""
    if not hinted(raw) and "\\u" not in raw and "\\/" not in raw:
        return []
    scalars = json_scalars(raw)
    if scalars is None:
        return scan_text(raw)
    out = []
    for s in scalars:
        text, places = unescape(raw[s.begin : s.end])
        key = re.sub(r"(?:\.?\[\d+\])+$", "", s.path).rsplit(".", 1)[-1]
        if key and sensitive_key(key) and not re.search(r"\s", text) and live_value(text, s.quoted):
            out.append(Finding(s.begin, s.end, "key", s.path, not s.quoted))
            continue
        for f in scan_text(text, s.path) if s.quoted else ():
            b, e = (f.begin, f.end) if places is None else (places[f.begin], places[f.end])
            out.append(Finding(s.begin + b, s.begin + e, f.kind, f.path))
    return out


def byte_spans(raw: str, found: list[Finding]) -> list[tuple[int, int]]:
    """The places of findings, which are in order, in bytes of UTF-8."""
    out, at, size = [], 0, 0
    for f in found:
        begin = size + len(raw[at : f.begin].encode("utf-8", "surrogatepass"))
        size = begin + len(raw[f.begin : f.end].encode("utf-8", "surrogatepass"))
        at = f.end
        out.append((begin, size))
    return out


def splice(raw: str, found: list[Finding], is_json: bool = False) -> str:
    """The text with each finding's bytes replaced by a typed mark, every other byte as it was; a JSON value without quotes becomes a string."""
    data, out, at = raw.encode("utf-8", "surrogatepass"), [], 0
    for f, (begin, end) in zip(found, byte_spans(raw, found), strict=True):
        mark = f"[REDACTED:{f.kind}]".encode()
        out += [data[at:begin], b'"' + mark + b'"' if is_json and f.bare else mark]
        at = end
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


FOUND = "block_id long, field string, key_path string, kind string, begin int, end int, secret string"
REDACTED = "block_id long, content string, input string, n_secrets int"


def _rows(batches: Iterator[pd.DataFrame], redact: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, content, given in zip(pdf["block_id"].tolist(), pdf["content"].tolist(), pdf["input"].tolist(), strict=True):
            a = scan_text(content) if content else []
            b = scan_json(given) if given else []
            if redact:
                out.append((i, splice(content, a) if a else content, splice(given, b, True) if b else given, len(a) + len(b)))
            else:
                for field, raw, found in (("content", content, a), ("input", given, b)):
                    out += [(i, field, f.path, f.kind, *span, raw[f.begin : f.end]) for f, span in zip(found, byte_spans(raw, found) if found else (), strict=True)]
        yield pd.DataFrame(out, columns=["block_id", "content", "input", "n_secrets"] if redact else ["block_id", "field", "key_path", "kind", "begin", "end", "secret"])


def _source(blocks: DataFrame) -> DataFrame:
    return spread(blocks.select(F.col("block_id").cast("long").alias("block_id"), "content", "input"))


def find_secrets(blocks: DataFrame) -> DataFrame:
    """One row per credential in ``content`` or ``input`` of (block_id, content, input); see FOUND.

    Nulls and empty texts give no row; ``input`` that is no JSON is read as text; a secret that stands twice gives two rows with
    different offsets; repeated rows each give theirs; rows without block_id keep a null one; extra columns are ignored. Offsets
    are in bytes of the field as stored (UTF-8).
    """
    return _source(blocks).mapInPandas(lambda it: _rows(it, False), FOUND)


def redact_secrets(blocks: DataFrame) -> DataFrame:
    """Every row with its credentials replaced and all else as it was; JSON stays JSON. Columns: see REDACTED."""
    return _source(blocks).mapInPandas(lambda it: _rows(it, True), REDACTED)
