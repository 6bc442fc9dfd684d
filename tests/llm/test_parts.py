"""Parts of the operators on small cases."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import chat, classlm, decontam, linededup, mixing, neardup, quality, suffixdedup, warc
from lodestone.llm import textkit as tk

from . import brute


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\té", max_size=12), min_size=1, max_size=6))
def test_words_and_lines(texts):
    for block in tk.blocks(pa.array(texts), 8):
        words, lines = tk.words(block), tk.lines(block)
        for d in range(block.n):
            text = texts[block.first + d]
            at = slice(words.first[d], words.first[d + 1])
            got = [bytes(block.data[a:b]).decode() for a, b in zip(words.starts[at], words.ends[at], strict=True)]
            assert got == brute.WORD.findall(text)
            at = slice(lines.first[d], lines.first[d + 1])
            assert [bytes(block.data[a:b]).decode() for a, b in zip(lines.starts[at], lines.ends[at], strict=True)] == text.split("\n")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=2, max_size=2), min_size=1, max_size=6))
def test_fm_index(text, patterns):
    index = decontam.FMIndex(np.array(text), 5, sample=3)
    low, high = index.search(np.array(patterns))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - 1) if text[i : i + 2] == p]
        assert sorted(index.locate(np.arange(a, b))) == want


def test_benchmark_in_blocks_agrees(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = decontam.find_contamination(docs, items).select("row.doc_id", "n_hit", "items", "spans")
    many = decontam.find_contamination(docs, items.limit(12), block_bytes=600).select("row.doc_id", "n_hit", "items", "spans")
    few = decontam.find_contamination(docs, items.limit(12)).select("row.doc_id", "n_hit", "items", "spans")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(many) == key(few)
    cut = decontam.find_contamination(docs, items, keep=["doc_id"], cut=True)
    again = decontam.find_contamination(cut.select("row.doc_id", "text"), items)
    assert one.where("n_hit > 0").count() > 0
    assert again.agg(F.sum("n_hit")).first()[0] <= one.agg(F.sum("n_hit")).first()[0] / 10


@settings(max_examples=40, deadline=None)
@given(st.text("ab<[&/]>s INSTEP", max_size=40))
def test_control_strings_come_back(text):
    import re

    stuffed = re.sub(chat._ESCAPE[0], r"\1&\2", text)
    assert re.sub(chat._UNESCAPE[0], r"\1\2", stuffed) == text
    assert not re.search(r"</?s>|\[/?INST\]|\[SEP\]", stuffed)


def test_chat_round_trip(spark, odd_dir):
    rows = spark.read.parquet(f"{odd_dir}/conversations.parquet")
    back = chat.read_back(chat.format_conversations(rows)).where("conv_id = 1").first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [("", "first"), ("user", "hi [INST] </s> &[INST] <&s> <s"), ("user", "again"), ("assistant", "one\ntwo"), ("assistant", ""), ("assistant", "[SEP]")]
    assert back["loss_text"] == "one\ntwo[SEP]"
    assert back["formatted"].count("<s>") == 3
    plan = chat.format_conversations(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_is_native(spark, sf_dir):
    plan = mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("url", [None, "http://a/b c", "x\r\ny"])
def test_warc_records(url):
    import hashlib

    payload = b"<html>" * 40
    digest = hashlib.sha256(payload).hexdigest()
    record = warc.build_record(7, url, payload, digest, None, "2024-01-01T00:00:00Z")
    parsed = warc.parse_record(record)
    assert parsed["payload"] == payload and parsed["x-page-id"] == "7"
    for bad in (record[:-1], record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"<html>", b"<HTML>", 1), record.replace(b"WARC-Type", b"WARC-Typo"), record + b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    revisit = warc.parse_record(warc.build_record(8, url, payload, digest, 7, "2024-01-01T00:00:00Z"))
    assert revisit["warc-type"] == "revisit" and revisit["payload_bytes"] == len(payload) and revisit["payload"] is None


def test_warc_frames_and_dictionary():
    import zstandard

    made = [warc.build_record(i, "u", f"page {i} ".encode() * 200, "0" * 64, None, "d").replace(b"sha256:" + b"0" * 64, b"other:1") for i in range(40)]
    out = list(warc.frames(iter(made)))
    assert out[0][:4] == (0x184D2A5D).to_bytes(4, "little") and len(out) == 41
    content = warc._BETWEEN.encode().join(out)
    assert [r for _, r in warc.records(content)] == made
    assert [r for _, r in warc.records(b"".join(warc.frames(iter(made[:3]))))] == made[:3]
    packed = zstandard.ZstdCompressor().compress(out[0][8:])
    nested = (0x184D2A5D).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed
    assert [r for _, r in warc.records(nested + b"".join(out[1:]))] == made
    with pytest.raises(warc.WarcError):
        list(warc.records(content[:-3]))
    with pytest.raises(warc.WarcError):
        list(warc.records(b"no frame"))


def test_warc_archives_roll(spark, tmp_path):
    """Archives of a partition stay near the size asked for, each with a dictionary of its own, and hold every record once."""
    pages = [(i, f"http://h/{i}", " ".join(str((i * 7919 + j * j) % 9973) for j in range(400))) for i in range(3000)] + [(3000, "u", "z" * 400_000), (3001, "u", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "out"), most=20_000)
    files = sorted((tmp_path / "out").glob("archive=*/part-*"))
    assert len(files) > 4 and all(f.stat().st_size < 20_000 + (1 << 20) for f in files)  # the sample a dictionary is trained on is at most 1 MiB
    got = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert sorted((r["page_id"], r["payload"].decode()) for r in got) == [(i, t or "") for i, _, t in pages]
    assert len({r["archive"] for r in got}) == len(files)


def test_trees_keep_the_order():
    rng = np.random.default_rng(1)
    x = rng.random((600, 2))
    y = ((x[:, 0] + 0.3 * rng.random(600)) < 0.6).astype(float)
    model = quality.fit_trees(x, y, [-1, 0])
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.85
    for b in (0.1, 0.5, 0.9):
        scores = model.score(np.stack([np.linspace(0, 1, 200), np.full(200, b)], 1))
        assert np.all(np.diff(scores) <= 1e-12)
    assert np.allclose(quality.fit_trees(x, np.ones(600), [0, 0]).score(x), quality.fit_trees(x, np.ones(600), [0, 0]).score(x)[0])


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    registers = neardup.bagminhash(doc, np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (registers[0] == registers[1]).mean() == pytest.approx(want, abs=0.035)


def test_near_group_of_many_edits(spark):
    """Links that neither the leader nor a shared neighbour gives: pairs far from the rest, and pairs inside a longer text."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(120)]
    docs, n = [], 0
    for _ in range(120):
        text = list(words)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            text[at] = f"x{rng.integers(0, 4)}"
        docs.append((n, " ".join(text)))
        n += 1
    for k in (60, 62, 64, 80, 90):
        docs.append((n, " ".join(words[:k])))
        n += 1
    for tail in ("p q r", "p q s", "q q"):
        docs.append((n, " ".join([*words[30:], *(f"y{i}" for i in range(40)), tail])))
        n += 1
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(frame).collect())
    assert got == sorted(brute.near_classes(docs))


def test_one_row_of_each_class_stays(spark):
    """Unlike texts under one id may be one class or two, and a class may lack an id."""
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long + " extra", "b"), (2, long + " more", "c"), (1, other, "d"), (1, other, "e"), (None, "no id here at all one", "f"), (None, "no id here at all one", "g"), (3, None, "h"), (4, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = sorted((r["doc_id"] or 0, (r["text"] or "")[-8:]) for r in neardup.keep_first(docs, neardup.near_duplicates(docs)).collect())
    assert len(kept) == 4 and [k[0] for k in kept] == [0, 1, 1, 3] and kept[0][1] == " all one"


def test_longest_previous_factors():
    """Against all pairs, with texts that hold the padding byte and contexts cut on both sides."""
    rng = np.random.default_rng(8)
    shape = suffixdedup.Shape(6, 2, 2)
    for _ in range(60):
        n = int(rng.integers(1, 30))
        rows = np.zeros((n, shape.width + 2), np.uint8)
        rows[:, : shape.width] = rng.integers(0, 2, (n, shape.width))
        rows[:, shape.reach : shape.reach + shape.gram] = 1
        left, right = rng.integers(0, shape.reach + 1, n), rng.integers(0, shape.reach + 1, n)
        column = np.arange(shape.width)
        rows[:, : shape.width][(column < shape.reach - left[:, None]) | (column >= shape.reach + shape.gram + right[:, None])] = 0
        rows[:, shape.width], rows[:, shape.width + 1] = left, right
        ids = rng.integers(0, 6, n)
        end = shape.reach + shape.gram + right
        seen = 0
        for s, own, factor in suffixdedup.longest_previous_factors(rows, ids, shape):
            assert sorted(own) == [i for i in range(n) if left[i] >= shape.reach - s and right[i] >= s]
            suffix = {i: bytes(rows[i, s : end[i]]) for i in own}
            assert [suffix[i] for i in own] == sorted(suffix.values())
            for i, f in zip(own, factor, strict=True):
                shared = [next((k for k, (x, y) in enumerate(zip(suffix[i], suffix[j])) if x != y), min(len(suffix[i]), len(suffix[j]))) for j in own if ids[j] < ids[i]]  # noqa: B905
                want = max(shared, default=0)
                assert f == (want if want >= shape.length else 0)
            seen += 1
        assert seen == shape.starts
        bits = suffixdedup.resolve(rows, ids, shape, at_once=4)
        for s, own, factor in suffixdedup.longest_previous_factors(rows, ids, shape):
            assert {int(i) for i in own[factor >= shape.length]} == {i for i in range(n) if bits[i] >> s & 1}


def test_hot_anchors_are_dealt_out_without_loss(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = suffixdedup.remove_repeats(docs, kept=False, hot=2, bucket_anchors=3000, chunk_bytes=1 << 16).drop("kept").collect()
    assert sorted(map(repr, few)) == sorted(map(repr, suffixdedup.remove_repeats(docs, kept=False).drop("kept").collect()))


def test_nearest_smaller_and_factors():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        values, common = rng.integers(0, 5, n), np.where(rng.random(n) < 0.7, 50, 0)
        common[0] = 0
        got = suffixdedup.nearest_smaller(values, common, 50)
        for i in range(n):
            j, shared, want = i, 50, 0
            while j > 0:
                shared = min(shared, common[j])
                j -= 1
                if shared < 50:
                    break
                if values[j] < values[i]:
                    want = shared
                    break
            assert got[i] == want


def test_anchors_cover_every_window():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc "), n)) for n in (0, 49, 50, 51, 400, 90)]
    (block,) = tk.blocks(pa.array(texts), 1 << 20)
    shape = suffixdedup.Shape()
    at = suffixdedup.anchors(block, shape)
    for d in range(block.n):
        own = at[(at >= block.offsets[d]) & (at < block.offsets[d + 1])]
        for start in range(block.offsets[d], block.offsets[d + 1] - shape.length + 1):
            assert np.any((own >= start) & (own + shape.gram <= start + shape.length))


def test_suffix_kept_texts(spark):
    shared = "a passage of well over fifty bytes that two documents have in common, word for word."
    rows = [(2, "before " + shared + " after"), (1, shared), (3, "x" * 120), (3, "x" * 120)]
    got = {(r["doc_id"], bytes(r["kept"]).decode()) for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, "before  after"), (1, shared), (3, "x" * 120)}


def test_boilerplate_needs_sites_beyond_copies(spark):
    rows = []
    for i in range(24):
        rows.append((i, f"own start number {i}\nshare this page now\nown end number {i}", f"s{i % 12}"))
        rows.append((100 + i, "a copied text begins\nand goes on here\nuntil it ends", f"s{i % 12}"))
        rows.append((200 + i, f"only on one site {i}\nread more about it\nlast {i}", "s0"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = {r["line"] for r in linededup.boilerplate(linededup.occurrences(frame)).collect()}
    want = frame.limit(1).select(F.xxhash64(F.lit("share this page now")).alias("h")).first()["h"]
    assert lines == {want}
    done = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame).select("row.doc_id", "text").collect()}
    assert done[0] == "own start number 0\nown end number 0" and done[100] == rows[1][1]


def test_exchange_finds_alternating_classes():
    bigrams = np.zeros((9, 9), np.int64)
    for a in range(1, 5):
        for b in range(5, 9):
            bigrams[a, b] = bigrams[b, a] = 10
    bigrams[0, 1] = bigrams[5, 0] = 3
    of = classlm.exchange(bigrams, 3, 0)
    assert of[0] == 0 and len(set(of[1:5])) == 1 and len(set(of[5:9])) == 1 and of[1] != of[5]


def test_class_model_beats_unigrams(spark, sf_dir):
    rows = classlm.op6_lm_scoring(spark, sf_dir).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def test_scores_by_brute_force(spark, sf_dir):
    """Classes of the middle words and scores, from the core's classes by the formulas of the module."""
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 5 == 0
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (~held).alias("train"))
    core, classed, _ = classlm.fit_classes(texts, 8, 300, 10, 1 << 16)
    rows = [(r["doc_id"], classlm.tokens(next(tk.blocks(pa.array([r["text"]]))))[0].tolist(), r["train"]) for r in texts.collect()]
    counts, table = Counter(w for _, ws, train in rows if train for w in ws), core.table
    number = lambda w: int(core.units.number(np.array([w], np.uint64))[0])
    basic = {w: int(core.class_of[number(w)]) for _, ws, _ in rows for w in ws}
    end = int(classlm.END[0])
    vectors = {}
    for _, ws, train in rows:
        for before, w, after in zip([end, *ws[:-1]], ws, [*ws[1:], None], strict=True) if train else ():
            if number(w) >= len(core.units.keys) and counts[w] >= 10:
                v = vectors.setdefault(w, np.zeros((2, 8)))
                v[0, basic[before]] += 1
                v[1, basic[after]] += 1
    smooth = table + 0.5
    share = np.log(smooth / np.outer(smooth.sum(1), smooth.sum(0)))
    got = {}
    for r in classed.collect():
        got |= dict(zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["kinds"], np.uint8).tolist(), strict=True))
    assert got.keys() == counts.keys() and len(vectors) > 20
    for w, c in got.items():
        gains = vectors[w][0] @ share + share @ vectors[w][1] if w in vectors else None
        assert c == basic[w] if gains is None else c and gains[c] >= gains[1:].max() - 1e-6

    kind = basic | got
    pairs = Counter((kind[a], kind[b]) for _, ws, train in rows if train for a, b in zip([end, *ws[:-1]], ws, strict=True))
    first, second, total = Counter(), Counter(), sum(pairs.values())
    for (a, b), n in pairs.items():
        first[a] += n
        second[b] += n
    class_tokens, class_types = Counter(), Counter()
    for w, n in counts.items():
        class_tokens[kind[w]] += n
        class_types[kind[w]] += 1

    def log10(a, b):
        step = (pairs[kind[a], kind[b]] + 10 * (second[kind[b]] + 0.5) / (total + 4)) / (first[kind[a]] + 10)
        return math.log10(step * (counts[b] + 0.5) / (class_tokens[kind[b]] + 0.5 * (class_types[kind[b]] + 1)))

    want = {d: sum(log10(a, b) for a, b in zip([end, *ws[:-1]], ws, strict=True)) for d, ws, _ in rows}
    found = {r["doc_id"]: r["score"] for r in classlm.score_documents(docs, held, 8, 300).collect()}
    assert found == pytest.approx(want)


def test_words_below_the_core_have_classes_of_their_own(spark):
    """Words of one shape, each too rare for the core, but seen in unlike places."""
    rng = np.random.default_rng(9)
    names = [f"{a}{b}{c}xx" for a in "bcdfghjklmnpqrs" for b in "aeiou" for c in "bdgklmnprst"][:800]
    things, deeds = names[:400], names[400:]
    texts = [" ".join(w for _ in range(10) for w in ("the", rng.choice(things), "will", rng.choice(deeds))) for _ in range(1000)]
    rows = [*enumerate(texts, 10), (1, f"the {things[7]} will {deeds[7]}"), (2, f"the {deeds[7]} will {things[7]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in classlm.score_documents(docs, F.col("doc_id") < 10, unit_share=1000).where("held_out").collect()}
    assert got[1]["base_score"] == pytest.approx(got[2]["base_score"])
    assert got[1]["score"] > got[2]["score"] + 0.5
