"""Reports, folds over failures, workloads and files against plain Python."""

import random

import pytest

from pyspark.sql import functions as F

from lodestone.functions import cost
from lodestone.operators import budget, chunking, ledger, lookup, mock, replay, report, retrieval, similar
from lodestone.sources import files


def plain_coalescing(rows, latency, timeout):
    """rows: (key, seq, t, fails) in order."""
    state, out = {}, {}
    for key, seq, t, fails in rows:
        owner, since, bad, done = state.get(key, (None, 0.0, False, None))
        if owner is not None and t <= since + latency:
            out[seq] = (owner, "gave_up" if since + latency - t > timeout else "failed" if bad else "coalesced")
        elif done is not None:
            out[seq] = (done, "hit")
        else:
            state[key] = (seq, t, fails, None if fails else seq)
            out[seq] = (seq, "failed" if fails else "miss")
    return out


def test_failing_computations(spark):
    rng = random.Random(11)
    t, rows = 0.0, []
    for i in range(400):
        t += rng.random() * 2
        rows.append((rng.choice("abcdefgh"), i, t, rng.random() < 0.6))
    df = spark.createDataFrame(rows, "key string, seq long, t double, fails boolean")
    got = {r.seq: (r.owner, r.outcome) for r in lookup.coalesced_calls(df, 9.0, 6.0, F.col("fails")).collect()}
    assert got == plain_coalescing(rows, 9.0, 6.0)
    assert {o for _, o in got.values()} == {"miss", "failed", "coalesced", "gave_up", "hit"}


def test_calls_behind_a_breaker(spark):
    rows = [("u", 0, 0, 0.0, 503.0), ("u", 0, 1, 1.0, None), ("u", 0, 2, 2.0, 200.0), ("u", 1, 0, 5.0, 200.0), ("u", 2, 0, 40.0, 404.0), ("u", 3, 0, 41.0, 429.0), ("u", 3, 1, 42.0, 200.0), ("v", 9, 0, 0.0, 500.0), ("v", 9, 1, 1.0, 500.0)]
    df = spark.createDataFrame(rows, "upstream string, call long, attempt int, t double, status double")
    got = {r.call: (r.attempts, r.outcome) for r in replay.calls(df, 1, 2, 30.0).collect()}
    assert got == {0: (2, "failed"), 1: (0, "fast_fail"), 2: (1, "rejected"), 3: (2, "ok"), 9: (2, "failed")}


def test_breaker_states_survive_batches(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), i, float(i), rng.choice([200, 503, 503])) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.seq: (r.admitted, r.state) for r in replay.breaker(spark.createDataFrame(rows, "upstream string, seq int, t double, status int"), 3, 20.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    machines = {}
    for u, seq, t, status in rows:
        b = machines.setdefault(u, replay.Breaker(3, 20.0))
        admitted = b.admit(t)
        if admitted:
            b.settle(status == 503, t)
        assert got[seq] == (admitted, b.state)


def test_one_key_with_half_the_rows(spark):
    rows = [("hot" if i % 2 else f"k{i}", float(i), i, "m", 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, t double, seq long, model string, est_tokens long")
    assert replay.expiry(df, 100.0).where("NOT hit AND key = 'hot'").count() == 40
    made = ledger.outcomes(df)
    assert made.where("outcome = 'miss'").count() == 2001 and made.count() == 4000
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_flushes(spark):
    rng = random.Random(4)
    flushes = sorted(rng.sample(range(20_000), 60))
    rows = replay.flushed(spark.range(20_000).withColumnRenamed("id", "seq"), spark.createDataFrame([(f,) for f in flushes * 2], "seq long"))
    got = {r.seq: r.epoch for r in rows.collect()}
    assert got == {i: sum(f < i for f in flushes) for i in range(20_000)}
    assert {r.epoch for r in replay.flushed(spark.range(5).withColumnRenamed("id", "seq"), spark.createDataFrame([], "seq long")).collect()} == {0}


def test_exact_share_of_edits(spark):
    rows = spark.range(1000).select("id", F.lit("t").alias("text"))
    for share in (0.0, 0.05, 0.123, 1.0):
        assert mock.edited_exactly(rows, "id", "text", share).where("text <> 't'").count() == int(1000 * share)


def test_generated_workloads(spark):
    rows = spark.range(20_000)
    shares = {r.kind: r["count"] / 20_000 for r in mock.hostile(rows, "id", "good").groupBy(F.substring("credential", 1, 3).alias("kind")).count().collect()}
    assert abs(shares["bad"] - 0.2) < 0.02 and abs(shares[""] - 0.05) < 0.01
    again = mock.sessions(spark, 200, 10, 0.45).select(F.col("intent") < F.col("session") * 10 + F.col("turn")).toPandas().iloc[:, 0].mean()
    assert abs(again - 0.45) < 0.05
    changed = mock.edited(rows.withColumn("text", F.lit("t")), "id", "text", 0.05).where("text <> 't'").count()
    assert abs(changed / 20_000 - 0.05) < 0.01
    draws = mock.zipf(spark, 20_000, 3000).select("rank").distinct().count()
    assert 0.85 < 1 - draws / 20_000 < 0.95  # repeats that a cache absorbs


def test_waits_and_drift(spark):
    r = spark.range(1).select(*[cost.backoff_ms(F.lit(a)) for a in (1, 2, 5, 9)], cost.backoff_ms(F.lit(1), F.lit(3.0)), cost.backoff_ms(F.lit(1), F.lit(60.0)), cost.backoff_ms(F.lit(3), F.lit(None).cast("double")), cost.drift(F.lit(90), F.lit(100))).first()
    assert list(r) == [250.0, 500.0, 4000.0, 4000.0, 3000.0, 5000.0, 1000.0, -10.0]


def test_chunk_sizes_are_made_consistent():
    assert chunking.options() == (200, 800, 2000) and chunking.options(900, 0, 500) == (500, 500, 500)
    assert chunking.options(100, 50, 400) == (100, 100, 400) and chunking.options(-1, 5000, 0) == (200, 2000, 2000)


def test_chunk_bytes_come_from_the_text(spark):
    docs = spark.createDataFrame([(1, "häßlich und schön " * 300), (2, ""), (3, None)], "doc_id int, text string")
    rows = chunking.exploded(docs, chunking.content_chunks(F.col("text"), data=True), "doc_id").orderBy("ordinal").collect()
    assert b"".join(bytes(r.data) for r in rows) == ("häßlich und schön " * 300).encode() and all(len(r.data) == r["size"] for r in rows)
    assert {r.doc_id for r in rows} == {1}
    lines = chunking.chunk_json(chunking.exploded(docs, chunking.fixed_chunks(F.col("text"), 5), "doc_id")).collect()
    assert len(lines) == -(-len(("häßlich und schön " * 300).encode()) // 5) and any("�" in r.value for r in lines)


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert files.read_snapshot(spark, path).count() == 0
    cache = spark.createDataFrame([("k", b"\x00\xff", 3, 0), ("l", None, None, 7)], files.CACHE)
    files.write_snapshot(cache, path)
    for _ in range(3):
        files.write_snapshot(files.read_snapshot(spark, path), path)
    assert sorted(files.read_snapshot(spark, path).collect(), key=str) == sorted(cache.collect(), key=str)
    assert len(list((tmp_path / "cache").iterdir())) == 2
    (tmp_path / "cache" / "version=000000099").mkdir()  # a version that never became whole
    assert files.read_snapshot(spark, path).count() == 2


def test_evictions_by_bytes(spark):
    df = spark.createDataFrame([(f"{i:064x}", 60, i) for i in range(200)], "key string, size int, seq int")
    pdf = replay.eviction(df, most_bytes=1600).toPandas()
    assert not pdf.hit.any()
    twice = df.unionByName(df.withColumn("seq", F.col("seq") + 200))
    held = replay.eviction(twice, most_bytes=1600).where("hit").count()
    assert held <= (1600 + 16 * 60) // 60


def test_served_neighbours(spark):
    found = spark.createDataFrame([("q1", "a", 0.9), ("q2", "b", 0.8), ("q3", "c", 0.95)], "q string, c string, similarity double")
    cache = spark.createDataFrame([("a", b"1", 1, 0), ("c", b"3", 1, 5)], files.CACHE)
    got = {r.q: r.outcome for r in lookup.serving(found, cache, F.lit(9)).collect()}
    assert got == {"q1": "semantic", "q2": "miss", "q3": "miss"}
    index = similar.indexed(spark.createDataFrame([("b", 2, "y"), ("a", 1, "x"), ("a", 3, "z"), ("c", 4, "w")], "id string, seq int, text string"), 2)
    assert sorted((r.id, r.text) for r in index.collect()) == [("a", "x"), ("b", "y")]


def test_budgets_for_display(spark):
    rows = spark.createDataFrame([("k1", 5, 15, 20), ("k2", 7, -1, 0)], "caller string, spent long, remaining long, token_limit long")
    shown = budget.display(rows, 3600, F.lit("2024-01-01 00:59:30").cast("timestamp_ntz"))
    import hashlib

    got = {r.caller: r for r in shown.collect()}
    assert set(got) == {hashlib.sha256(k.encode()).hexdigest()[:8] for k in ("k1", "k2")} and {r.resets_in for r in got.values()} == {30}


def test_report_as_text(spark):
    calls = spark.createDataFrame([("embedding", 200, 0, False, False, 1, 2), ("passthrough", 200, 0, False, False, 0, 0), ("embedding", 502, 2, False, False, 3, 1), ("embedding", 503, 0, True, False, 0, 0), ("embedding", 429, 0, False, True, 0, 0)], "kind string, status int, retries int, fast_failed boolean, over_budget boolean, calls int, sent int")
    items = spark.createDataFrame([("m", "miss", 10, 0), ("m", "hit", 0, 10), ("n", "coalesced", 0, 5), ("n", "semantic", 0, 5)], "model string, outcome string, spent long, saved long")
    cache = spark.createDataFrame([("a", b"12345", 1, 0)], files.CACHE)
    observed = spark.createDataFrame([(0.9,), (1.0,)], "cosine double")
    whole = report.full(calls, items, cache, observed, breaker_open=True)
    r = whole.first()
    assert (r.requests, r.passthrough, r.errors, r.upstream_calls, r.upstream_items, r.retries, r.fast_fails, r.budget_rejects) == (1, 1, 2, 4, 3, 2, 1, 1)
    assert (r["items"], r.hits, r.misses, r.coalesced, r.semantic_hits, r.hit_rate, r.cache_bytes, r.shadow_samples) == (4, 2, 1, 1, 1, 0.75, 5, 2)
    text = report.render(whole, ledger.usage(items, "model"), spark.createDataFrame([("c1", 5, 20, 15, 30), ("c2", 5, 0, -1, 30)], "caller string, spent long, token_limit long, remaining long, resets_in long"))
    for part in ("open (1 failed fast)", "over budget           1", "75.0 %", "2 neighbours, cosine 0.9500 on average, 0.9000 at least", "c1  5 of 20 spent, resets in 30 s", "c2  5 spent, unlimited", "duplicate share       66.7 %"):
        assert part in text, part
    exposed = ledger.render_prometheus(report.samples(whole))
    assert exposed.count("# TYPE") == 15 and 'engine_items_total{result="coalesced"} 1' in exposed and "engine_breaker_open 1" in exposed
    assert ledger.render_summary(ledger.duplicate_summary(spark.createDataFrame([("k", "m", 1, 4), ("k", "m", 2, 4)], "key string, model string, seq long, est_tokens long"))).startswith("items        2 (1 unique, 1 duplicate, 50.0 %)")


def test_evaluation_of_judged_queries(spark):
    ranking = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1), (3, "z", 1)], "qid int, id string, rank int")
    qrels = spark.createDataFrame([(1, "y", 1), (2, "x", 1)], "query_id int, doc_id string, relevance int")
    r = retrieval.evaluate(ranking, qrels).first()
    assert r.queries == 2 and r.recall == 1.0 and abs(r.ndcg - (0.6309297535714575 + 1) / 2) < 1e-12


def served_one_by_one(rows, threshold, most=0):
    """rows (id, seq, model, text): the plain loop, in which a request's leaders are seen from the next one on."""
    out, lead, waiting, now = [], {}, [], None
    for i, seq, model, text in sorted(rows, key=lambda r: (r[1], str(r[0]))):
        if seq != now:
            for m, key, own in waiting:
                if key not in lead.setdefault(m, {}) and (not most or len(lead[m]) < most):
                    lead[m][key] = own
            waiting, now = [], seq
        padded = " " + " ".join(text.split()) + " "
        own = {padded[k : k + 3] for k in range(len(padded) - 2)} or {padded}
        found = [(-len(own & g) / len(own | g), k) for k, g in lead.get(model, {}).items() if len(own & g) / len(own | g) >= threshold]
        if found:
            best = min(found)
            out.append((str(i), best[1], round(-best[0], 9)))
        else:
            out.append((str(i), str(i), 1.0))
            waiting.append((model, str(i), own))
    return sorted(out)


@pytest.mark.parametrize(("width", "most"), [(1, 0), (4, 0), (3, 5), (1, 2)])
def test_active_serving_matches_a_plain_loop(spark, width, most):
    rng = random.Random(width * 7 + most)
    texts = {k: " ".join(rng.choice(["red", "green", "blue", "cyan"]) for _ in range(rng.randrange(1, 6))) for k in range(70)}
    order = [*texts, *rng.sample(sorted(texts), 25)]  # some come again
    rows = [(i, k // width, "m" if i % 3 else "n", texts[i]) for k, i in enumerate(order)]
    if width > 1:
        rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "id int, seq int, model string, text string")
    got = sorted((r.id, r.served_by, round(r.similarity, 9)) for r in similar.active(df, 0.6, most_keys=most).collect())
    assert got == served_one_by_one(rows, 0.6, most)


def test_a_long_chain_of_leaders(spark):
    """Each row is near the one before it only: every second row leads."""
    chain = spark.range(1, 40).selectExpr("id AS q", "id - 1 AS c")
    assert sorted(r.q for r in similar.leaders(chain).collect()) == list(range(1, 40, 2))


def test_near_rows_that_agree_in_all_columns(spark):
    text = "the lantern of the harbor is lit"
    rows = [(0, "m", 256, text), (1, "m", None, text), (2, "m", 256, text + "!"), (3, "m", None, text), (4, None, None, text), (5, None, None, text), (6, "n", 256, text)]
    df = spark.createDataFrame([(i, i, m, d, t) for i, m, d, t in rows], "id int, seq int, model string, dimensions int, text string")
    assert {(r.q, r.c) for r in similar.pairs(df, 0.6, by=["model", "dimensions"]).collect()} == {(2, 0), (3, 1), (5, 4)}
    assert {r.id: r.served_by for r in similar.active(df, 0.6, by=["model", "dimensions"]).collect()} == {"0": "0", "1": "1", "2": "0", "3": "1", "4": "4", "5": "4", "6": "6"}


def test_trigrams_of_long_and_rare_texts(spark):
    from lodestone.functions import sql, text

    long_text = " ".join(f"w{i}é" for i in range(60_000))
    df = spark.createDataFrame([("a😀b",), ("",), (long_text,)], "t string")
    sql.register(spark)
    df.createOrReplaceTempView("trigram_texts")
    for rows in (df.select(text.trigrams(F.col("t")).alias("g")).collect(), spark.sql("SELECT char_trigrams(t) AS g FROM trigram_texts").collect()):
        assert sorted(rows[0].g) == sorted([" a😀", "a😀b", "😀b "]) and rows[1].g == ["  "]
        padded = f" {long_text} "
        assert set(rows[2].g) == {padded[i : i + 3] for i in range(len(padded) - 2)}


def test_exact_edits_with_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, None)] * 3, "id int, text string")
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = mock.edited_exactly(rows, "id", "text", share, 3).collect()
        edited = [r for r in got if (r.text or "").endswith(" edited")]
        assert len(got) == 18 and int(18 * share) - 3 <= len(edited) <= int(18 * share)
        if share < 0.9:
            whole = mock.edited_exactly(rows.na.fill({"text": "d"}), "id", "text", share, 3).where("text LIKE '% edited'").count()
            assert whole == int(18 * share)


def test_sql_trigrams_are_made_in_arrow_and_keep_their_order(spark):
    """An array of a text's characters, made by Spark's expressions, cost most of sql_functions."""
    from lodestone.functions import sql, text

    sql.register(spark)
    texts = ["", "a", "abcabcab", " A  b\u2003C ", "漢字 😀 Red 漢字 😀", "x" * 500, None] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    df.createOrReplaceTempView("ordered_trigrams")
    got = spark.sql("SELECT i, t, char_trigrams(t) AS g FROM ordered_trigrams")
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.withColumn("want", text.trigrams(F.col("t"))).collect()
    assert len(rows) == len(texts) and all(r.g == r.want for r in rows) and rows[2].g == [" ab", "abc", "bca", "cab", "ab "]


def test_spread_tasks_do_not_grow_with_the_input(spark, tmp_path):
    from lodestone.sources import tables

    spark.range(0, 200_000, 1, 40).write.parquet(f"{tmp_path}/numbers.parquet")
    rows = tables.table(spark, str(tmp_path), "numbers")
    few = tables.spread(rows).rdd.getNumPartitions()
    many = tables.spread(rows, task_bytes=4096)
    assert many.rdd.getNumPartitions() > 2 * few and many.count() == 200_000
    assert tables.spread(rows, task_bytes=1 << 40).rdd.getNumPartitions() == few
