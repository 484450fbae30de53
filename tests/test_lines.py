"""The source of log lines: any ranges, limits, streams."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import lines


def written(tmp_path, seed=1):
    draw = random.Random(seed)
    texts = {}
    for name in ("b/x.jsonl", "a.jsonl", "b/y.jsonl", "b/_skip", "c.jsonl"):
        rows = ["é" * draw.randrange(6) + "z" * draw.choice([0, 1, 5, 60]) + draw.choice(["", " ", "\t"]) for _ in range(draw.randrange(1, 60))]
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(draw.choice(["\n", "\r\n"]).join(rows).encode() + (b"\n" if draw.random() < 0.5 else b""))
        texts[name] = path
    (tmp_path / "empty.jsonl").write_bytes(b"")
    return [str(tmp_path / p) for p in ("b", "a.jsonl", "empty.jsonl", "c.jsonl")], [texts[k] for k in ("b/x.jsonl", "b/y.jsonl", "a.jsonl", "c.jsonl")]


def plain(files):
    out = []
    for f in files:
        out += [x.removesuffix(b"\r").decode() for x in f.read_bytes().split(b"\n") if x.strip()]
    return out


@pytest.mark.parametrize("split", [1, 2, 7, 64, 1 << 20])
def test_any_ranges(tmp_path, split):
    paths, files = written(tmp_path, split)
    reader = lines.LineReader({"paths": __import__("json").dumps(paths), "splitBytes": str(split)})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["value"] for r in got] == plain(files) and len({r["seq"] for r in got}) == len(got) and sorted(r["seq"] for r in got) == [r["seq"] for r in got]


def test_one_scan_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "_CHUNK", 16)
    paths, files = written(tmp_path, 9)
    rows = lines.read_lines(spark, paths, split_bytes=50)
    assert [r.value for r in rows.orderBy("seq").collect()] == plain(files)
    plan = rows.where(F.length("value") > 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and "Exchange" not in plan and "Join" not in plan


def test_lines_over_the_limit(spark, tmp_path):
    (tmp_path / "log").write_text("short\n" + "x" * 5000 + "\nshort\n")
    assert lines.read_lines(spark, str(tmp_path / "log"), most_bytes=5000).count() == 3
    with pytest.raises(Exception, match="byte 6 is longer than 4999 bytes"):
        lines.read_lines(spark, str(tmp_path / "log"), most_bytes=4999, split_bytes=100).collect()
    with pytest.raises(Exception, match="nothing"):
        lines.read_lines(spark, str(tmp_path / "nothing")).collect()


def test_growing_logs(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a").write_text("one\ntwo\nthr")
    query = lines.stream_lines(spark, str(folder), split_bytes=5).writeStream.format("memory").queryName("growing").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
        assert sorted(r.value for r in spark.table("growing").collect()) == ["one", "two"]
        with (folder / "a").open("a") as f:
            f.write("ee\n\nfour\n")
        (folder / "b").write_text("five\nsix")
        query.processAllAvailable()
        assert sorted((r.value, r["at"]) for r in spark.table("growing").collect()) == [("five", 0), ("four", 15), ("one", 0), ("three", 8), ("two", 4)]
    finally:
        query.stop()
