"""Log levels, redacted JSON log lines, and bounded redaction of nested values."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: Names of levels, lowest first.
LEVELS = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "warning": 3, "error": 4, "silent": 5}
MAX_DEPTH, MAX_ITEMS, MAX_CHARS = 5, 25, 2000


def level_number(name: Column, default: str = "info") -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), F.lower(F.trim(name)))
    return F.coalesce(known, F.lit(LEVELS[default]))


def json_line(ts: Column, level: Column, message: Column, fields: Column) -> Column:
    return F.to_json(F.struct(ts.alias("ts"), F.lower(level).alias("level"), T.redact(message).alias("message"), fields.alias("fields")))


_RULES = [(re.compile(p, re.ASCII), r.replace("$1", r"\1").replace("$2", r"\2").replace("$3", r"\3")) for p, r in T.SECRET_RULES]


def _sensitive(key: str) -> bool:
    plain = re.sub("[-_]", "", key.lower())
    return bool(re.search(T.SENSITIVE_KEY, plain) or (re.search(T.SENSITIVE_AUTH[0], plain) and re.search(T.SENSITIVE_AUTH[1], key)))


def redact_value(value, depth: int = 0):
    """Secrets masked by key or by pattern; at most MAX_DEPTH levels, MAX_ITEMS items of a list and MAX_CHARS of a string, which is masked before it is cut."""
    if isinstance(value, str):
        for pattern, to in _RULES:
            value = pattern.sub(to, value)
        return value if len(value) <= MAX_CHARS else value[:MAX_CHARS] + "... [truncated]"
    if isinstance(value, dict | list) and depth >= MAX_DEPTH:
        return "[MaxDepthExceeded]"
    if isinstance(value, list):
        rest = len(value) - MAX_ITEMS
        return [redact_value(v, depth + 1) for v in value[:MAX_ITEMS]] + ([f"[+{rest} more items]"] if rest > 0 else [])
    if isinstance(value, dict):
        return {k: T.REDACTED if _sensitive(k) else redact_value(v, depth + 1) for k, v in value.items()}
    return value


def redact_json(raw: Column) -> Column:
    """redact_value over JSON text; text that is no JSON is redacted as a string."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(redact_value(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return redact_value(text)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return run(raw)


def text_line(ts: Column, level: Column, module: Column, message: Column, fields: Column | None = None, error: Column | None = None) -> Column:
    """`[time] [LEVEL] [module] message {fields}`, and the error in a line of its own."""
    nothing = F.lit("")
    tag = F.when(F.coalesce(module, nothing) != "", F.concat(F.lit(" ["), module, F.lit("]"))).otherwise(nothing)
    more = nothing if fields is None else F.when(F.to_json(fields) != "{}", F.concat(F.lit(" "), F.to_json(fields))).otherwise(nothing)
    below = nothing if error is None else F.when(F.coalesce(error, nothing) != "", F.concat(F.lit("\n"), error)).otherwise(nothing)
    return F.concat(F.lit("["), ts, F.lit("] ["), F.upper(F.coalesce(level, F.lit("info"))), F.lit("]"), tag, F.lit(" "), T.redact(message), more, below)


MAX_CAUSES = 5


def serialized_error(value, depth: int = 0) -> dict:
    """name, masked message, stack, code and cause of an error given as JSON; causes go at most MAX_CAUSES deep."""
    if depth >= MAX_CAUSES:
        return {"name": "Error", "message": "[MaxDepthExceeded]"}
    if isinstance(value, str):
        return {"name": "Error", "message": redact_value(value)}
    if isinstance(value, bool | int | float):
        return {"name": "Error", "message": json.dumps(value)}
    if not isinstance(value, dict):
        return {"name": "Error", "message": "Unknown error"}
    text = next((value[k] for k in ("message", "msg") if isinstance(value.get(k), str)), "Unknown error")
    out = {"name": value["name"] if isinstance(value.get("name"), str) and value["name"] else "Error", "message": redact_value(text)}
    if isinstance(value.get("stack"), str):
        out["stack"] = redact_value(value["stack"])
    if isinstance(value.get("code"), str | int):
        out["code"] = value["code"]
    if value.get("cause") is not None:
        out["cause"] = serialized_error(value["cause"], depth + 1)
    return out


def error_json(raw: Column) -> Column:
    """serialized_error over JSON text; text that is no JSON is the message."""

    def one(text: str | None) -> str:
        try:
            value = None if text is None else json.loads(text)
        except ValueError:
            value = text
        return json.dumps(serialized_error(value), ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return run(raw)
