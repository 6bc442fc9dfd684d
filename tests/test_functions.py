import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import kinds, text, vectors


@pytest.mark.parametrize(
    "a, b, d",
    [("", "", 0), ("a", "", 1), ("Color", "Color", 0), ("NavgationStack", "NavigationStack", 1), ("Collor", "Color", 1), ("abcd", "abdc", 1), ("ca", "abc", 3)],
)
def test_edit_distance(a, b, d):
    assert text.osa_distance(a, b) == d
    assert text.osa_distance(b, a) == d


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edit_distance_bounds(a, b):
    d = text.osa_distance(a, b)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert (d == 0) == (a == b)


def test_query_cleaning():
    assert text.sanitize_query('"foo* (bar)"') == "foo bar"
    assert text.sanitize_query("***") == ""
    assert text.camel_words("NavigationStack") == ["Navigation", "Stack"]
    assert text.camel_words("URLSession") == ["URL", "Session"]
    assert text.query_tokens("Café_x foo-bar") == ["cafe", "x", "foo", "bar"]
    assert text.glob_pattern("a_b%*?") == r"a\_b\%%_"


def test_tokens_fold_accents(spark):
    row = spark.createDataFrame([("Café_x foo-bar Ünï", None)], "a string, b string").select(text.tokens(F.col("a")).alias("a"), text.tokens(F.col("b")).alias("b")).first()
    assert row["a"] == ["cafe", "x", "foo", "bar", "uni"]
    assert row["b"] == []


def test_redaction_masks_and_keeps(spark):
    jwt = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".sig"
    block = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    cases = {f"x {jwt} y": "x [REDACTED] y", block: "[REDACTED]", "https://h/p?key=abc&page=2": "https://h/p?key=[REDACTED]&page=2", "plain words": "plain words"}
    rows = spark.createDataFrame(list(cases.items()), "a string, want string").withColumn("got", text.redact(F.col("a"))).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert spark.createDataFrame([(None,)], "a string").select(text.redact(F.col("a"))).first()[0] == ""


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 1.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0)]
    got = spark.createDataFrame(rows, "a array<float>, b array<float>, want double").withColumn("got", vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert [r["got"] for r in got] == pytest.approx([r["want"] for r in got])


def test_float32_blobs(spark):
    import struct

    blobs = [(bytearray(struct.pack("<3f", 1.0, -2.5, 0.25)),), (bytearray(b""),), (bytearray(b"abc"),), (None,)]
    got = [r[0] for r in spark.createDataFrame(blobs, "b binary").select(vectors.decode_float32(F.col("b"))).collect()]
    assert got == [[1.0, -2.5, 0.25], None, None, None]


def test_kinds(spark):
    rows = [("Instance Method", None, None, "method"), (None, " Structure ", None, "struct"), (None, None, "Article", "article"), (None, None, "symbol", "unknown"), (None, None, None, "unknown"), ("odd", None, "Foo", "foo")]
    got = spark.createDataFrame(rows, "a string, b string, c string, want string").withColumn("got", kinds.resolve(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
