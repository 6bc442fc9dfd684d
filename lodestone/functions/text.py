"""Text functions as Spark columns: folding, tokens, globs, edit distance, trimming, redaction."""

from __future__ import annotations

import re
import unicodedata
from string import ascii_lowercase

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> dict[str, str]:
    """Small Latin letters that decompose to a letter of ASCII and marks, by Unicode's own tables; and one that has no decomposition."""
    found = {"ł": "l"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if chr(code).islower() and len(parts) > 1 and parts[0] in ascii_lowercase and all(map(unicodedata.combining, parts[1:])):
            found[chr(code)] = parts[0]
    return found


PLAIN_LETTERS = _plain_letters()
MARK = r"\p{Mn}"
TOKEN = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without accents, composed or not; null is empty.  ASCII text skips the letter-by-letter translation."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.regexp_replace(F.translate(low, "".join(PLAIN_LETTERS), "".join(PLAIN_LETTERS.values())), MARK, ""))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def query_tokens(query: str) -> list[str]:
    """Tokens of a query string, on the driver, by the rules of `tokens`."""
    plain = query.lower().translate(str.maketrans(PLAIN_LETTERS))
    return re.findall(r"[^\W_]+", "".join(c for c in plain if unicodedata.category(c) != "Mn"))


def sanitize_query(query: str) -> str:
    """Search operators become spaces; a query without a letter or digit is empty."""
    if not re.search(r"[a-zA-Z0-9]", query or ""):
        return ""
    return re.sub(r"\s+", " ", re.sub(r"[\"'*^:(){}\[\]~+]", " ", query)).strip()


def camel_words(token: str) -> list[str]:
    """Words of a camelCase name: breaks stand before a capital that follows a small letter or digit, or begins a word."""
    return [w for w in re.split(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", token) if w]


def glob_pattern(glob: str) -> str:
    """A LIKE pattern: * is any run, ? any one character, and the pattern's own signs are escaped."""
    out = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return out.replace("*", "%").replace("?", "_")


def contains_folded(text: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def trim_with_ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, max(0, n - 3)), F.lit("..."))).otherwise(text)


def osa_distance(a: str, b: str, cap: int | None = None) -> int:
    """Optimal string alignment: insert, delete, replace, and swap of neighbours each cost 1."""
    if a == b:
        return 0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        if cap is not None and min(new) > cap:
            return cap + 1
        before, row = row, new
    return row[-1]


def osa_distances(left: list[str], right: list[str]) -> np.ndarray:
    """osa_distance of each pair, all pairs together cell by cell."""
    n, sizes = len(left), [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    a, b = (np.full((n, max(1, int(s.max(initial=0)))), fill, np.int64) for s, fill in zip(sizes, (-1, -2), strict=True))
    for codes, side in ((a, left), (b, right)):
        for i, x in enumerate(side):
            codes[i, : len(x)] = np.frombuffer(x.encode("utf-32-le"), "<u4")
    width = b.shape[1]
    before, row = None, np.broadcast_to(np.arange(width + 1), (n, width + 1)).copy()
    out = np.where(sizes[0] == 0, sizes[1], 0)
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(width):
            best = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + (a[:, i] != b[:, j]))
            if i and j:
                swapped = (a[:, i] == b[:, j - 1]) & (a[:, i - 1] == b[:, j])
                best = np.where(swapped, np.minimum(best, before[:, j - 1] + 1), best)
            new[:, j + 1] = best
        before, row = row, new
        ends = np.flatnonzero(sizes[0] == i + 1)
        out[ends] = row[ends, sizes[1][ends]]
    return out


def osa(left: Column, right: Column) -> Column:
    """osa_distance of lower-cased columns, in Arrow batches; pairs of short names are taken together."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
        pairs = sorted(set(known), key=lambda p: (max(map(len, p)), p))
        short = [p for p in pairs if max(map(len, p)) <= 128]
        found = {p: osa_distance(*p) for p in pairs[len(short) :]}
        for at in range(0, len(short), 1024):
            part = short[at : at + 1024]
            found |= dict(zip(part, osa_distances([x for x, _ in part], [y for _, y in part]).tolist(), strict=True))
        return pd.Series([found.get((x, y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(F.lower(left), F.lower(right))


def similarity_ratio(left: Column, right: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - osa(left, right) / longest)


REDACTED = "[REDACTED]"
#: Patterns of secrets, in order, and what replaces a match.
SECRET_RULES = (
    (r"(?i)-----BEGIN[ A-Z0-9_-]*PRIVATE KEY-----[\s\S]*?-----END[ A-Z0-9_-]*PRIVATE KEY-----", REDACTED),
    (r"\bAIza[0-9A-Za-z\-_]{16,}\b", REDACTED),
    (r"\bsk-(?:ant-)?[a-zA-Z0-9_\-]{20,}\b", REDACTED),
    (r"\bhf_[a-zA-Z0-9]{20,}\b", REDACTED),
    (r"\b(?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{20,}\b", REDACTED),
    (r"\bgithub_pat_[a-zA-Z0-9_]{20,}\b", REDACTED),
    (r"\b(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}\b", REDACTED),
    (r"(?i)\b(bearer\s+)[A-Za-z0-9\-._~+/]+=*", "$1" + REDACTED),
    (r"\beyJ[a-zA-Z0-9_\-]{10,}\.eyJ[a-zA-Z0-9_\-]{10,}\.[a-zA-Z0-9_\-]+\b", REDACTED),
    (r"(?i)((?:https?|ftp)://[^:/\s@]+:)([^@/\s]+)(@)", "$1" + REDACTED + "$3"),
    (r"(?i)([?&](?:key|token|api_?key|secret|password|passwd|auth|access_token|client_secret)=)[^&\s]+", "$1" + REDACTED),
    (r"(?i)((?:password|passwd|client_secret|clientSecret|secretKey|(?:[a-zA-Z0-9_]+_)?api_?key|access_token|token|secret)\s*[:=]\s*[\"']?)[^\s\"',;&]+([\"']?)", "$1" + REDACTED + "$2"),
)
#: A text without any of these (in lower case) holds nothing that SECRET_RULES match; plain substring tests cost a fraction of the patterns.
SECRET_MARKS = ("private key-----", "aiza", "sk-", "hf_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "akia", "abia", "acca", "asia", "bearer", "eyj", "://", "key", "token", "secret", "passw", "auth=")
#: Parts of a key name that mark its value as secret.
SENSITIVE_PARTS = ("password", "passwd", "secret", "apikey", "privatekey", "token", "credential", "cookie", "session", "authorization", "authentication")
#: A key is sensitive if its small letters without - and _ match the first pattern, or match the second while the key as written matches the third.
SENSITIVE_KEY = "|".join(SENSITIVE_PARTS) + "|^auth$|^signature$|^(?!.*(certain|concert))(.*certificate|cert|.*cert$)"
SENSITIVE_AUTH = ("^auth", "Token|Header|_|-")


def redact(text: Column) -> Column:
    """Secrets replaced rule by rule; null is empty."""
    out, marked = F.coalesce(text, F.lit("")), F.lit(False)
    for mark in SECRET_MARKS:
        marked = marked | F.contains(F.lower(text), F.lit(mark))
    for pattern, to in SECRET_RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.when(marked, out).otherwise(F.coalesce(text, F.lit("")))


def is_sensitive_key(key: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(key, F.lit(""))), "[-_]", "")
    return F.coalesce(plain.rlike(SENSITIVE_KEY) | (plain.rlike(SENSITIVE_AUTH[0]) & key.rlike(SENSITIVE_AUTH[1])), F.lit(False))


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def age_days(then: Column, now: Column) -> Column:
    """Whole days from then to now, never below 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)).cast("long")
