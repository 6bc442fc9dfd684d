"""Runs against brute force: Lyndon arrays, ranks, cuts and whole results."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import registry, runs

from .brute import WORD, sha
from .test_operators import documents, path, plain, run  # noqa: F401


def strings(seed, rounds):
    rng = random.Random(seed)
    for _ in range(rounds):
        n, letters, out = rng.randint(0, 40), rng.choice([1, 2, 2, 3]), []
        while len(out) < n:
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 5))]
            out += unit * rng.choice([1, 1, 2, 5, 7])
        yield out


def brute_next(s):
    follows = [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) for i in range(len(s))]
    agree = [next((k for k in range(len(s) - j) if s[i + k] != s[j + k]), len(s) - j) for i, j in enumerate(follows)]
    return follows, agree


def brute_runs(s):
    out = []
    for q in range(1, len(s) // 4 + 1):
        i = 0
        while i + q < len(s):
            begin = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            length = i - begin + q
            if length >= max(6, 4 * q) and not any(s[begin + d : begin + length] == s[begin : begin + length - d] for d in range(1, q)):
                out.append((begin, length, q))
            i += i == begin
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays_and_runs():
    for s in strings(1, 4000):
        assert runs.next_smaller(s) == brute_next(s)
        assert runs.runs_of(s) == brute_runs(s)


def test_cutting_loses_no_run():
    for s in strings(2, 2000):
        rank = np.array(s, np.int64)
        got = [(lo + a, b, c) for lo, hi in runs.stretches(rank, np.zeros(len(s), np.int64)) for a, b, c in runs.runs_of(s[lo:hi])]
        assert sorted(got, key=lambda r: (r[0], r[2])) == brute_runs(s)


class Counted(int):
    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def test_letters_are_compared_a_constant_number_of_times():
    a, b = [1], [1, 2]
    while len(b) < 4000:
        a, b = b, b + a
    rng = random.Random(3)
    unit = [rng.randrange(900) for _ in range(700)]
    for s in ([1] * 5000, [1, 2] * 2500, b, unit * 7, [rng.randrange(2) for _ in range(5000)], ([1] * 70 + [0]) * 70):
        Counted.seen = 0
        runs.next_smaller([Counted(x) for x in s])
        assert Counted.seen <= 3 * len(s)


def test_ranks_follow_the_bytes():
    rng = random.Random(4)
    spans = [bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.choice([1, 2, 6, 7, 8, 13, 14, 15, 22]))) for _ in range(3000)]
    spans += [b"x" * 300, b"x" * 300, b"x" * 299 + b"y", b"x" * 112, b"x" * 113]
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    ordered = sorted(spans)
    assert runs.ranks(data, ends - [len(s) for s in spans], ends).tolist() == [ordered.index(s) for s in spans]


def wound(doc_id, text):
    ws = WORD.findall(text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(ws)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    return ws


def expected(doc_id, text):
    ws = wound(doc_id, text)
    found = brute_runs(ws) if len(ws) < 4000 else runs.runs_of(np.unique(ws, return_inverse=True)[1].tolist())
    gone = {i for a, b, c in found for i in range(a + c, a + b)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    told = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    return doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(told), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))


def test_whole_results(spark, path):  # noqa: F811
    want = plain(expected(d, t) for d, t in documents(spark, path))
    assert run(spark, "op11_runs", path, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256") == want


@pytest.mark.parametrize("text", ["a b " * 9 + "c", "x " * 6, "x " * 5, "", None, "one two " * 4 + "one\n\ttwo three", "e " * 200_000])
def test_operator_on_texts(spark, text):
    row = runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.col("runs"), "collapsed").first()
    ws = (text or "").split()
    found = brute_runs(ws) if len(ws) < 1000 else [(0, len(ws), 1)]
    assert [tuple(r) for r in row["runs"]] == found
    gone = {i for a, b, c in found for i in range(a + c, a + b)}
    assert row["collapsed"] == " ".join(w for i, w in enumerate(ws) if i not in gone)


def test_registered():
    assert "op11_runs" in registry.QUERIES and "op11_runs" in registry.ORACLE_SQL
