import json

from lodestone.streaming import jobs


def test_postings_and_fan_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in [{"ts": "1", "level": "error", "message": "token=abc now"}, {"ts": "2", "level": "debug", "message": "quiet"}]))
    source = lambda: spark.readStream.schema("ts string, level string, message string").json(str(tmp_path / "in"))
    seen = []
    jobs.fan_out(source(), {"list": lambda b, n: seen.extend(r["message"] for r in b.collect())}, str(tmp_path / "c1")).awaitTermination(120)
    assert seen == ["token=[REDACTED] now"]
    jobs.postings_stream(source(), "ts", ["message"], str(tmp_path / "postings"), str(tmp_path / "c2")).awaitTermination(120)
    assert {(r["doc"], r["term"]) for r in spark.read.parquet(str(tmp_path / "postings")).collect()} == {("1", "token"), ("1", "abc"), ("1", "now"), ("2", "quiet")}
