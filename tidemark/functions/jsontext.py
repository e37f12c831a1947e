"""JSON values by their spelling: "42", 42 and 42.0 are three values, and of a repeated key the last counts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = re.compile(r"[ \t\r\n]*")
_DECODER = json.JSONDecoder()
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?\Z")


def members(text: str | None) -> dict[str, str]:
    """The keys of a JSON object, and the text of each value as it is spelled; {} for anything else."""
    out: dict[str, str] = {}
    if not text:
        return out
    try:
        at = _SPACE.match(text).end()
        if text[at] != "{":
            return out
        at = _SPACE.match(text, at + 1).end()
        while text[at] != "}":
            key, at = _DECODER.raw_decode(text, at)
            at = _SPACE.match(text, _SPACE.match(text, at).end() + 1).end()
            start = at
            _, at = _DECODER.raw_decode(text, at)
            out[key] = text[start:at]
            at = _SPACE.match(text, at).end()
            if text[at] == ",":
                at = _SPACE.match(text, at + 1).end()
        return out
    except (ValueError, IndexError):
        return {}


def kind_of(value: str) -> str:
    """null, boolean, integer, float, text, list or object."""
    if value in ("true", "false"):
        return "boolean"
    if value == "null":
        return value
    m = _NUMBER.match(value)
    if m:
        return "float" if m[1] or m[2] else "integer"
    return {'"': "text", "[": "list", "{": "object"}[value[0]]


def says(text: str | None, wanted: str) -> bool:
    """Whether a value at any depth (never a key) holds a text, in any case."""
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return False
    todo = [found]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, list):
            todo += x
        elif x is not None and wanted.lower() in (x if isinstance(x, str) else json.dumps(x)).lower():
            return True
    return False


def members_column():
    @F.pandas_udf("map<string,string>")
    def json_members(s: pd.Series) -> pd.Series:
        return s.map(members)

    return json_members


def kinds_column():
    @F.pandas_udf("map<string,string>")
    def json_kinds(s: pd.Series) -> pd.Series:
        return s.map(lambda t: {k: kind_of(v) for k, v in members(t).items()})

    return json_kinds


def says_column(wanted: str):
    @F.pandas_udf("boolean")
    def json_says(s: pd.Series) -> pd.Series:
        return s.map(lambda t: says(t, wanted))

    return json_says


# A flat object without escapes is read by the JVM alone; other texts go to the parser.
_WS, _STRING = "[ \\t\\r\\n]*", '"[^"\\\\\\x00-\\x1f]*"'
_SCALAR = _STRING + "|-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null"
_FLAT = "^" + _WS + "\\{" + _WS + "(?:" + _STRING + _WS + ":" + _WS + "(?:" + _SCALAR + ")" + _WS + "(?:," + _WS + '(?=")|(?=\\})))*\\}' + _WS + "\\z"


def value_of(text: Column, key: str) -> Column:
    """The JSON text of a key of an object as it is spelled; null if it is absent, or if the text is no object."""
    parsed = members_column()
    if not key or re.search(r'["\\\x00-\x1f]', key):
        return parsed(text)[key]
    flat = F.coalesce(text.rlike(_FLAT), F.lit(False))
    quoted = re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", key) if key.isascii() else key
    said = F.regexp_extract(text, "(?s)^.*[{,]" + _WS + '"' + quoted + '"' + _WS + ":" + _WS + "(" + _SCALAR + ")", 1)  # the last one counts
    return F.when(flat, F.nullif(said, F.lit(""))).otherwise(parsed(F.when(~flat, text))[key])
