"""Delta tables: whole commits, filters, batches tried again, merging."""

import os

from pyspark.sql import functions as F

from lodestone.sources import deltas
from lodestone.sources.deltas import DeltaTable
from lodestone.streaming import live


def keyed(spark, numbers, value=0):
    return spark.createDataFrame([(f"k{n}", n, value) for n in numbers], "key string, n long, value long")


def test_commits_and_filters(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "t"))
    assert table.read("key string").count() == 0 and table.missing(keyed(spark, [1])).count() == 1
    table.commit(keyed(spark, range(0, 300)))
    table.commit(keyed(spark, range(300, 600)))
    table.commit(keyed(spark, []))
    assert table.read().count() == 600 and len(table.manifest()["deltas"]) == 2
    first, second = (d["name"] for d in table.manifest()["deltas"])
    assert {d["name"] for d in table.may_hold(keyed(spark, [5, 7]))} >= {first}
    assert {d["name"] for d in table.may_hold(keyed(spark, [305, 2]))} == {first, second}
    assert sorted(r.n for r in table.missing(keyed(spark, [0, 299, 300, 599, 600, 9999])).collect()) == [600, 9999]
    false = sum(len(table.may_hold(keyed(spark, [n]))) for n in range(10_000, 10_012))
    assert false <= 2


def test_batches_once_and_unfinished_commits(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "t"))
    assert table.commit(keyed(spark, [1]), 0, "w") and not table.commit(keyed(spark, [1]), 0, "w")
    assert table.commit(keyed(spark, [2]), 0, "other") and table.commit(keyed(spark, [3]), 1, "w")
    keyed(spark, [4]).write.parquet(str(tmp_path / "t" / "delta-lost" / "rows"))  # a writer that died before its manifest
    assert sorted(r.n for r in table.read().collect()) == [1, 2, 3]
    table.compact()
    assert not os.path.exists(tmp_path / "t" / "delta-lost") and table.read().count() == 3


def test_merging(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(deltas, "FAN", 3)
    table = DeltaTable(spark, str(tmp_path / "t"))
    for k in range(10):
        table.commit(keyed(spark, range(5), k))
        seen = table.read()
        table.compact(lambda rows: rows.groupBy("key", "n").agg(F.max("value").alias("value")))
        assert seen.count() >= 5  # a reader from before the merge still finds its files
    levels = [d["level"] for d in table.manifest()["deltas"]]
    assert sorted(levels) == [0, 2] and {(r.n, r.value) for r in table.read().groupBy("n").agg(F.max("value").alias("value")).collect()} == {(n, 9) for n in range(5)}
    assert len([f for f in os.listdir(tmp_path / "t" / "_manifests") if f.endswith(".json")]) <= deltas.KEEP


def test_a_batch_writes_only_what_is_new(spark, tmp_path):
    """What a batch writes and the deltas it reads do not grow with the tier."""
    source, path = tmp_path / "in", str(tmp_path / "tier")
    written = []
    for k in range(5):
        keyed(spark, range(200 * k, 200 * k + 220)).coalesce(1).write.mode("append").parquet(str(source))
        before = {d["name"] for d in DeltaTable(spark, path).manifest()["deltas"]}
        stream = spark.readStream.schema("key string, n long, value long").parquet(str(source))
        live.append_new(stream, path, str(tmp_path / "check")).awaitTermination()
        written.append([d["rows"] for d in DeltaTable(spark, path).manifest()["deltas"] if d["name"] not in before])
    assert written == [[220], [200], [200], [200], [200]]
    assert live.tier(spark, path).count() == live.tier(spark, path).select("key").distinct().count() == 1020
    table = DeltaTable(spark, path)
    assert len(table.may_hold(keyed(spark, range(900, 905)))) <= 2
