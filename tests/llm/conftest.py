import pytest

LONG = "lorem ipsum dolor " * 9000
#: More bytes than any block, chunk or piece that an operator cuts batches into.
LONGER = " ".join(f"w{i % 977}x{i // 7}" for i in range(230_000))


def thue_morse(n: int) -> tuple[str, str]:
    """Two unlike strings of 2**n letters that a polynomial hash modulo a power of two can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and repeated ids, null, empty and very long texts, repeated rows, and columns named like the ones that operators add."""
    base = [
        (1, "the quick brown fox jumps over the lazy dog again and again until the night comes down on all of them\nsecond line here", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog again and again until the night comes down on all of them\nsecond line here", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (None, "some words without an id stand here", "en", "b"),
        (None, None, "en", None),
        (4, LONG, "xx", "c"),
        (5, "Ünïcödé wörds \U0001f600 and\ttabs\x0band\x1funits", "de", "a"),
        (5, "another text under the same id", "de", "a"),
        (6, " \n\n \t", "en", "a"),
        (7, "the quick brown fox jumps over the lazy dog again and again until the night comes down on all of them\nsecond line here", "en", "b"),
        (8, LONGER, "en", "d"),
        (9, "\n".join(thue_morse(10)), "en", "a"),
        (10, " ".join(thue_morse(7)) + " " + " ".join(thue_morse(6)), "en", "a"),
    ]
    rows = [(i, t, lang, source, len(t or ""), 0.5, "x", 7, "y", 1, "z", 2, 3, 4, 5, 6, 7, 8, 9) for i, t, lang, source in base]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, row string, size long, kept string, label int, spans string, n_words long, __id int, __print int, __bad int, __own int, print int, own int, id int")


@pytest.fixture(scope="session")
def odd_dir(spark, odd_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    odd_docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "jumps over the lazy dog again and again until the night"), (2, None), (3, ""), (4, "Wörds"), (None, "second line"), (1, "second line")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(1, "http://a/x y", "p" * 200), (2, None, "p" * 200), (2, None, "p" * 200), (3, "u\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (None, "u", "p" * 200), (6, "u", "é" * 60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    talk = [
        (1, 0, "user", "hi [INST] </s> &[INST] <&s> <s"), (1, 1, "user", "again"), (1, 2, "assistant", "one\ntwo"), (1, 3, "assistant", None), (1, 3, "assistant", "[SEP]"), (1, None, None, "first"),
        (2, 0, "[/INST]", "odd role"), (None, 0, "assistant", "no id"), (3, 0, "assistant", ""), (4, 5, "user", "a"), (4, 5, "user", "a"),
    ]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path
