"""Byte-exact JSON tokenising: templates, values, nested keys, key scan and array spans.

Spark's JSON functions normalise numbers and blanks, so exact tokens come from these scanners, run
as Arrow-batched functions. A template is the text between values: key names, order, blanks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[ \t\r\n]+|[^ \t\r\n"{}\[\],:]+', re.S)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"(?=[ \t\r\n]*(:)?)', re.S)


_BLANK, _QUOTED, _PLAIN = r"[ \t\r\n]*+", r'"(?:[^"\\]|\\.)*+"', r'[^ \t\r\n"{}\[\],:]++'
#: A member whose value is a string, a plain token or an object without further brackets, and what ends it.
_MEMBER = re.compile(rf'{_BLANK}({_QUOTED}){_BLANK}:{_BLANK}({_QUOTED}|{_PLAIN}|\{{(?:[^{{}}\[\]"]|{_QUOTED})*+\}}){_BLANK}([,}}])', re.S)
_OPEN = re.compile(rf"{_BLANK}\{{")


def _flat_members(text: str) -> tuple[list[tuple[str, int, int]], int] | None:
    """:func:`scan_members` of an object whose members are all simple ones, a match for each; None for any other."""
    m = _OPEN.match(text)
    members: list[tuple[str, int, int]] = []
    while m and (m := _MEMBER.match(text, m.end())):
        members.append((m[1], m.start(2), m.end(2)))
        if m[3] == "}":
            return members, m.end()
    return None


def scan_members(text: str) -> tuple[list[tuple[str, int, int]], int] | None:
    """Members of the object that ``text`` starts with: (quoted key, value begin, value end), and the
    object's end. None if it isn't a well-formed object; what follows the object isn't looked at."""
    return _flat_members(text) or _scanned_members(text)


def _scanned_members(text: str) -> tuple[list[tuple[str, int, int]], int] | None:
    """:func:`scan_members`, token by token."""
    depth, state, key, begin, last = 0, "open", "", 0, 0
    members: list[tuple[str, int, int]] = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        t, at = m[0], m.end()
        if t[0] in " \t\r\n":
            continue
        if depth == 0:
            if t != "{":
                return None
            depth, state = 1, "key_or_end"
        elif depth == 1 and state in ("key", "key_or_end"):
            if t == "}" and state == "key_or_end":
                return members, at
            if t[0] != '"':
                return None
            key, state = t, "colon"
        elif depth == 1 and state == "colon":
            if t != ":":
                return None
            state = "value"
        elif depth == 1 and state == "value":
            if t in ("}", "]", ",", ":"):
                return None
            begin, last = m.start(), at
            depth += t in ("{", "[")
            state = "after"
        elif depth == 1:
            if t not in (",", "}"):
                return None
            members.append((key, begin, last))
            if t == "}":
                return members, at
            state = "key"
        else:
            depth += (t in ("{", "[")) - (t in ("}", "]"))
            last = at
    return None


def parse_row(line: str | None) -> tuple[list[str], list[str]] | None:
    """(template parts, value tokens) of an object on a line; what follows it joins the last part."""
    found = scan_members(line) if line else None
    if not found or not found[0]:
        return None
    parts, values, at = [], [], 0
    for _, begin, end in found[0]:
        parts.append(line[at:begin])
        values.append(line[begin:end])
        at = end
    return [*parts, line[at:]], values


def nested_members(token: str | None) -> list[tuple[str, str]] | None:
    """(sub-key, value token) of an object token, in order, repeated keys too; None if it is no object."""
    found = scan_members(token) if token else None
    if not found or found[1] != len(token):
        return None
    return [(key[1:-1], token[begin:end]) for key, begin, end in found[0]]


def parts_of(token: str | None) -> tuple[list[str], list[str], list[str]] | None:
    """(template parts, sub-keys, value tokens) of an object token with a member or more, scanned once."""
    found = scan_members(token) if token else None
    if not found or not found[0] or found[1] != len(token):
        return None
    begins, ends = [b for _, b, _ in found[0]], [e for _, _, e in found[0]]
    parts = [token[a:b] for a, b in zip([0, *ends], [*begins, len(token)], strict=True)]
    return parts, [k[1:-1] for k, _, _ in found[0]], [token[b:e] for b, e in zip(begins, ends, strict=True)]


def find_keys(text: str | None) -> list[str]:
    """Every quoted string that a colon follows, nested ones too; strings are skipped as wholes."""
    return [m[1] for m in _KEY.finditer(text or "") if m[2]]


def array_spans(text: str | None) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(begin, end, elements) of every array that holds objects only; elements are (begin, end)."""
    out, stack = [], []
    for m in _TOKEN.finditer(text or ""):
        t = m[0]
        if t == "[":
            stack.append([m.start(), [], True])
        elif t == "{":
            stack.append([m.start(), None, True])
        elif t in ("]", "}") and stack:
            begin, elements, good = stack.pop()
            if t == "]" and elements and good:
                out.append((begin, m.end(), elements))
            if stack and stack[-1][1] is not None:
                if t == "}":
                    stack[-1][1].append((begin, m.end()))
                else:
                    stack[-1][2] = False
        elif stack and stack[-1][1] is not None and t != "," and t[0] not in " \t\r\n":
            stack[-1][2] = False
    return sorted(out)


def largest_array(text: str | None) -> tuple[int, int, list[tuple[int, int]]] | None:
    """The array with the most objects; the first wins ties."""
    return max(array_spans(text), key=lambda s: len(s[2]), default=None)


@F.pandas_udf(_struct(template=_STRINGS, vals=_STRINGS))
def row_tokens(line: pd.Series) -> pd.DataFrame:
    got = [parse_row(x) or (None, None) for x in line]
    return pd.DataFrame({"template": [a for a, _ in got], "vals": [b for _, b in got]})


@F.pandas_udf(_struct(template=_STRINGS, keys=_STRINGS, vals=_STRINGS))
def object_parts(token: pd.Series) -> pd.DataFrame:
    """Template, sub-keys and value tokens of object tokens with a member or more; nulls for all others."""
    rows = []
    for x in token:
        rows.append(parts_of(x) or (None, None, None))
    return pd.DataFrame(rows, columns=["template", "keys", "vals"])


#: A string, with the colon that makes it a key; it never gives back, so long strings cost one pass.
STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:[ \t\r\n]*+:)?+'


def strings(text: str | Column) -> Column:
    """All strings of a JSON text in order, those that are keys with their colon."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(STRING), F.lit(0))


def key_of(string: Column) -> Column:
    """The key that a string of :func:`strings` is, or null."""
    return F.when(string.endswith(":"), F.regexp_extract(string, r'(?s)^"(.*)"[ \t\r\n]*:$', 1))


def key_list(text: str | Column) -> Column:
    """Every quoted string that a colon follows, nested ones too."""
    return F.transform(F.filter(strings(text), lambda t: t.endswith(":")), key_of)


@F.pandas_udf(_struct(prefix=T.StringType(), elements=_STRINGS, separators=_STRINGS, suffix=T.StringType()))
def array_parts(text: pd.Series) -> pd.DataFrame:
    rows = []
    for x in text:
        span = largest_array(x)
        if span is None:
            rows.append((None, None, None, None))
            continue
        e = span[2]
        rows.append((x[: e[0][0]], [x[a:b] for a, b in e], [x[a[1] : b[0]] for a, b in zip(e, e[1:], strict=False)], x[e[-1][1] :]))
    return pd.DataFrame(rows, columns=["prefix", "elements", "separators", "suffix"])
