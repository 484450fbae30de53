"""Searches by rounds, heavy keys, and streams whose state is bounded."""

import datetime
import json
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import analyze, heavy, ledger, report
from lodestone.streaming import live


@pytest.mark.parametrize(("cuts", "last"), [(64, 10_000), (4, 3), (8, 1)])
def test_percentiles_by_search(spark, monkeypatch, cuts, last):
    monkeypatch.setattr(ledger, "CUTS", cuts)
    monkeypatch.setattr(ledger, "LAST", last)
    draw = random.Random(cuts)
    groups = {
        "even": [float(k) for k in range(700)],
        "wide": [draw.choice([-1, 1]) * 10.0 ** draw.randrange(-300, 300) for _ in range(300)],
        "ties": [1.0] * 400 + [2.0] * 3 + [None] * 50,
        "edge": [float("-inf"), float("inf"), -0.5, 0.5, float("inf")],
        "one": [5.0],
        "none": [None],
        None: [3.0, 1.0, 2.0],
    }
    rows = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "g string, v double")
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: tuple(r)[1:] for r in ledger.rank_floor_percentiles(rows, "v", points, ["g"]).collect()}
    want = {g: tuple(sorted(own)[int(p * (len(own) - 1))] for p in points.values()) for g, all_ in groups.items() if (own := [v for v in all_ if v is not None])}
    assert got == want
    big = spark.range(3000).selectExpr("(1L << 60) + id * 3 AS v")
    r = ledger.rank_floor_percentiles(big, "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (r.p50, r.p99) == ((1 << 60) + 3 * 1499, (1 << 60) + 3 * 2969)
    assert ledger.rank_floor_percentiles(rows.where("false"), "v", points, ["g"]).count() == 0


def test_no_window_over_a_group(spark):
    rows = spark.range(300_000).selectExpr("'g' AS g", "id * 0.5 AS v").repartition(4)
    r = ledger.rank_floor_percentiles(rows, "v", {"p50": 0.5, "p99": 0.99}, ["g"]).first()
    assert (r.p50, r.p99) == (0.5 * 149_999, 0.5 * 296_999)


def test_counters_keep_their_bounds():
    draw = np.random.default_rng(2)
    keys = [f"k{int(k)}" for k in draw.zipf(1.3, 20_000) if k < 5000]
    true = Counter(keys)
    whole, parts = heavy.Counters(50), [heavy.Counters(50) for _ in range(4)]
    for i, k in enumerate(keys):
        parts[i % 4].add([k], np.array([1]))
    error = 0
    for p in parts:
        rows = p.rows()
        error += int(rows["error"].sum())
        own = rows[rows["key"].notna()]
        whole.add(own["key"].tolist(), own["weight"].to_numpy())
    left = whole.rows()
    error += int(left["error"].sum())
    assert error <= len(keys) / 51 and len(left) <= 51
    held = dict(zip(left["key"], left["weight"], strict=True))
    assert all(held.get(k, 0) <= n <= held.get(k, 0) + error for k, n in true.items())


def test_heavy_keys_are_exact(spark):
    draw = random.Random(3)
    rows = [(k, f"key{int(draw.paretovariate(0.9)) % 3000}", 1) for k in range(6000)] + [(9000 + k, None, 5) for k in range(3)]
    items = spark.createDataFrame(rows, "seq long, key string, n long").select("seq", F.lit("m").alias("model"), "key", (F.length("key") + 3).cast("long").alias("est_tokens"), F.col("key").alias("text")).repartition(6)
    want = ledger.top_duplicates(items.where("key IS NOT NULL"), 10).collect()
    for most in (2, 16, 5000):
        assert sorted(heavy.top_duplicates(items, 10, most).collect()) == sorted(want)
    assert heavy.top_duplicates(items.where("false"), 10).count() == 0


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_state_of_expiring_keys_stays_flat(spark, tmp_path):
    """Ten files, each of new keys an hour later: state holds those of the ttl and the delay."""
    schema = "key string, seq long, t_ms long, at timestamp"
    base = int(at(0).replace(tzinfo=datetime.UTC).timestamp() * 1000)
    rows = [(f"k{h}-{k}", h * 100 + k, base + (h * 3600 + k) * 1000, at(h * 3600 + k)) for h in range(10) for k in range(40)]
    rows += [(f"k{h}-0", 5000 + h, base + (h * 3600 + 50) * 1000, at(h * 3600 + 50)) for h in range(10)]
    for h in range(10):
        own = [r for r in rows if r[0].startswith(f"k{h}-")]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/h={h}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/h=*"))
    query = live.expiring(stream, 60_000, "at", "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, query.recentProgress) if p["stateOperators"]]
    assert len(sizes) >= 10 and max(sizes) <= 80 and sizes[-1] <= 40
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 410 and sorted(r.key for r in out if r.hit) == sorted(f"k{h}-0" for h in range(10))


def test_sketch_of_a_stream(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(f"k{n % (7 + k)}", 1 + n % 3) for n in range(200)], "key string, est_tokens long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, est_tokens long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.heavy_keys(stream, str(tmp_path / "sketch"), str(tmp_path / "check"), 6).awaitTermination()
    kept = live.tier(spark, str(tmp_path / "sketch"))
    assert kept.count() <= 7 and 0 < heavy.error_of(kept) <= 1600 / 7
    true = {r.key: r.w for r in spark.read.parquet(str(tmp_path / "in")).groupBy("key").agg(F.sum("est_tokens").alias("w")).collect()}
    held = {r.key: r.weight for r in kept.where("key IS NOT NULL").collect()}
    assert all(held.get(k, 0) <= w <= held.get(k, 0) + heavy.error_of(kept) for k, w in true.items())


def test_logs_added_in_any_order(spark, tmp_path):
    lines = [json.dumps({"model": f"m{k % 3}", "input": [f"text {k % 7}", f"own {k}"]}) if k % 5 else "junk" for k in range(60)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "seq long, value string")
    want = [sorted(map(str, part.collect())) for part in analyze.analyze(frame)]
    kept = analyze.Analysis(spark, str(tmp_path / "kept"))
    order = list(range(6))
    random.Random(1).shuffle(order)
    for k in (*order, order[0]):
        kept.add(frame.where(F.expr(f"seq div 10 = {k}")), f"log{k}", k)
    whole = kept.state()
    assert [sorted(map(str, part.collect())) for part in (analyze.summary(whole), analyze.by_model(whole), analyze.top(whole))] == want
    plan = analyze.summary(analyze.state(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1


def test_a_report_gathered_while_the_ledger_is_written(spark, tmp_path):
    items = spark.createDataFrame([("text-embedding-3-large", o, 10 * (o == "miss"), 7 * (o != "miss")) for o in ("miss", "hit", "coalesced", "semantic", "miss")], "model string, outcome string, spent long, saved long").repartition(3)
    calls = spark.createDataFrame([("embedding", 200, 0, False, False, 1, 2)], "kind string, status int, retries int, fast_failed boolean, over_budget boolean, calls int, sent int")
    cache = spark.createDataFrame([("a", b"12345", 1, 0)], "key string, raw binary, tokens long, expires_at long")
    whole = report.full(calls, items, cache)
    seen, counts = report.gathered(items)
    seen.write.parquet(str(tmp_path / "ledger"))
    again = report.full(calls, counts, cache)
    assert again.columns == whole.columns and again.collect() == whole.collect()
    r = whole.first()
    assert (r["items"], r.hits, r.misses, r.coalesced, r.semantic_hits, r.saved_tokens, r.spent_tokens) == (5, 2, 2, 1, 1, 21, 20)
    plan = report.full(calls, spark.read.parquet(str(tmp_path / "ledger")), cache)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_live_counters_of_a_stream(spark, tmp_path):
    rows = [("m", o, 5, 0) if o == "miss" else ("m", o, 0, 5) for o in ("miss", "hit", "hit", "coalesced") * 10]
    for _ in range(3):
        spark.createDataFrame(rows, "model string, outcome string, spent long, saved long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("model string, outcome string, spent long, saved long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counters = live.LiveCounters("ledger")
    spark.streams.addListener(counters)
    try:
        query = stream.observe("ledger", *report.measures()).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 30
        while counters.totals.get("items") != 120 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert (counters.totals["items"], counters.totals["hits"], counters.totals["misses"], counters.totals["coalesced"], counters.totals["saved_tokens"]) == (120, 60, 30, 30, 450)
