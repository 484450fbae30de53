"""Lookups, budgets, replay, similarity, retrieval and chunking against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import cost
from lodestone.operators import budget, chunking, ledger, lookup, mock, replay, retrieval, similar


def test_batch_lookup_keeps_order(spark):
    items = spark.createDataFrame([(1, p, k) for p, k in enumerate("XXYX")], "b int, pos int, key string")
    cache = spark.createDataFrame([], "key string, raw binary, tokens long, expires_at long")
    missing = lookup.distinct_missing(items, cache, "b", "pos")
    assert {r.key: r.first_pos for r in missing.collect()} == {"X": 0, "Y": 2}
    computed = missing.select("key", F.lower("key").alias("raw"))
    assert lookup.reassemble(lookup.scatter(items, computed), "b", "pos", "raw").first()["values"] == ["x", "x", "y", "x"]
    status = lookup.batch_status(lookup.probe(items, cache), "b").first()
    assert (status.status, status.computed) == ("miss", 2)


def test_expired_entries_are_misses(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", None, 1, 0), ("b", None, 1, 10), ("c", None, 1, 9)], "key string, raw binary, tokens long, expires_at long")
    assert {r.key: r.hit for r in lookup.probe(items, cache, F.lit(10)).collect()} == {"a": True, "b": True, "c": False}


def test_apportion_sums_to_total(spark):
    rows = [(t, p, e, t) for t in (1, 3, 17, 100, 12345) for p, e in enumerate((5, 1, 9))]
    got = cost.apportion(spark.createDataFrame(rows, "b int, p int, e long, t long"), "b", "p", "e", "t").groupBy("b").agg(F.sum("share").alias("s")).collect()
    assert all(r.b == r.s for r in got)


def test_budget_gate_matches_sequential(spark):
    rng = random.Random(5)
    rows = [(str(rng.randrange(4)), rng.randrange(3), i, rng.randrange(1, 40)) for i in range(400)]
    limits = spark.createDataFrame([("0", 50), ("1", 0)], "caller string, token_limit long")
    df = budget.with_limits(spark.createDataFrame(rows, "caller string, win int, seq int, tokens long"), limits, 100)
    got = {r.seq: r.allowed for r in budget.gate(df).collect()}
    spent = {}
    for caller, win, seq, tokens in rows:
        limit = {"0": 50, "1": 0}.get(caller, 100)
        ok = limit <= 0 or spent.get((caller, win), 0) < limit
        spent[caller, win] = spent.get((caller, win), 0) + (tokens if ok else 0)
        assert got[seq] is ok


def test_budget_gate_spreads_one_caller(spark):
    rng = random.Random(9)
    rows = [(None if i % 7 == 0 else "hot", 0, i * 50, rng.randrange(1, 40)) for i in range(1000)]
    df = budget.with_limits(spark.createDataFrame(rows, "caller string, win int, seq long, tokens long"), spark.createDataFrame([], "caller string, token_limit long"), 5000)
    gated = budget.gate(df)
    plan = gated._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "seq#" in line]
    assert windows and all("_bucket" in line for line in windows)
    spent = {}
    for r in gated.orderBy("seq").collect():
        before = spent.get(r.caller, 0)
        assert (r.spent_before, r.allowed, r.spent) == (before, before < 5000, r.tokens if before < 5000 else 0)
        spent[r.caller] = before + r.spent
    assert len(gated.columns) == len(df.columns) + 3


def test_expiry_matches_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), float(t), t) for t in range(200)]
    df = spark.createDataFrame(rows, "key string, t double, seq long")
    a = {r.seq: r.hit for r in replay.expiry(df, 7.0).collect()}
    since, want = {}, {}
    for k, t, s in rows:
        want[s] = k in since and t <= since[k] + 7
        if not want[s]:
            since[k] = t
    assert a == want


def test_eviction_bounds(spark):
    df = spark.createDataFrame([(f"{i:064x}", 60, i) for i in range(300)] + [(f"{299:064x}", 60, 300)], "key string, size int, seq int")
    rows = replay.eviction(df, most_entries=64).collect()
    assert sum(r.hit for r in rows) == 1


def test_breaker_sequence(spark):
    rows = [("u", 0, 0.0, 500), ("u", 1, 1.0, None), ("u", 2, 2.0, 200), ("u", 3, 12.0, 503), ("u", 4, 13.0, 200), ("u", 5, 23.0, 404), ("u", 6, 24.0, 200)]
    got = replay.breaker(spark.createDataFrame(rows, "upstream string, seq int, t double, status int"), 2, 10.0).orderBy("seq").collect()
    assert [(r.admitted, r.state) for r in got] == [(True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_coupled_budget_and_verdicts(spark):
    rows = [(0, "a", 0, "k1", 10, 10), (1, "a", 0, "k2", 5, 10), (2, "b", 0, "k2", 5, 10), (3, "a", 0, "k2", 5, 10)]
    got = replay.coupled_budget(spark.createDataFrame(rows, "seq int, caller string, win int, key string, tokens int, token_limit int")).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["miss", "refused", "miss", "hit"]
    rows = [("c", 0, 0.0, False), ("c", 1, 30.0, True), ("c", 2, 61.0, True), ("c", 3, 100.0, False), ("c", 4, 400.0, None)]
    got = replay.verdicts(spark.createDataFrame(rows, "credential string, seq int, t double, answer boolean"), 300.0).orderBy("seq").collect()
    assert [(r.asked, r.allowed) for r in got] == [(True, False), (False, False), (True, True), (False, True), (True, False)]


def grams(s):
    p = " " + " ".join(s.lower().split()) + " "
    return {p[i : i + 3] for i in range(len(p) - 2)} or {p}


def test_pairs_match_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["red", "green", "blue", "cyan", "grey", "pink"]) for _ in range(rng.randrange(1, 8))) for _ in range(60)] + ["", "a"]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id int, seq int, text string")
    got = {(r.q, r.c): r.similarity for r in similar.pairs(df, 0.6).collect()}
    want = {(i, j): s for i in range(len(texts)) for j in range(i) if (s := len(grams(texts[i]) & grams(texts[j])) / len(grams(texts[i]) | grams(texts[j]))) >= 0.6}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_pairs_by_blocks_match_prefixes(spark, monkeypatch, threshold):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["red", "green", "blue", "cyan", "grey", "pink"]) for _ in range(rng.randrange(1, 9))) for _ in range(150)] + ["", "a", None, "漢字 red", "red 漢字"] * 2
    df = spark.createDataFrame([(i, i, t, rng.choice(["m", "n", None])) for i, t in enumerate(texts)], "id int, seq int, text string, model string")
    got = []
    for meetings in (0, 10**9):  # blocks, then prefixes
        monkeypatch.setattr(similar, "MEETINGS", meetings)
        monkeypatch.setattr(similar, "GRID", 16)
        monkeypatch.setattr(similar, "COLUMNS", 7)
        monkeypatch.setattr(similar, "PIVOTS", 3)
        got.append(sorted((r.q, r.c, round(r.similarity, 12)) for r in similar.pairs(df, threshold).collect()))
    assert got[0] == got[1] and got[0]


def test_gram_sets_match_the_columns(spark):
    from lodestone.functions.text import trigram_codes

    texts = ["", "a", " A  b ", "漢字 😀 red", "Ünï\u2003code\tText " * 9, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = similar._sets(df).select("id", "text", "grams", "n", "digest").withColumn("want", F.sort_array(trigram_codes(F.col("text")))).collect()
    assert all(r.grams == r.want and (r.digest is None) == (r.text is None) for r in got) and len({r.digest for r in got}) == len(texts)


def block_of(sets):
    """The sets by size, as blocks are written."""
    sets.sort(key=len)
    own, codes = np.unique(np.concatenate(sets), return_inverse=True)
    return similar._Block({"ids": list(range(len(sets))), "sizes": np.array([len(s) for s in sets], "<i4").tobytes(), "own": own.astype("<i8").tobytes(), "codes": codes.astype("<i4").tobytes()})


@pytest.mark.parametrize(("threshold", "sketches", "many"), [(0.6, ((0, 16), (24, 32)), 0.02), (0.3, ((8, 8),), 1.0), (1.0, ((0, 4),), 0.0), (0.6, ((500, 3),), 1.0)])
def test_sketches_lose_no_pair(monkeypatch, threshold, sketches, many):
    """Sets of like grams, near copies among them, against all pairs."""
    monkeypatch.setattr(similar, "SKETCHES", sketches)
    monkeypatch.setattr(similar, "MANY", many)
    monkeypatch.setattr(similar, "SLAB", 32)
    monkeypatch.setattr(similar, "TILE", 48)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.zipf(1.4, rng.integers(5, 90)) % 97) for _ in range(150)]
    sets += [np.unique(np.append(s[rng.random(len(s)) > 0.1], 3)) for s in sets[:60]]
    them = [s[::2] if k % 3 else s for k, s in enumerate(sets)]
    a, b = block_of(sets), block_of(them)
    for other, same, them in ((a, True, sets), (b, False, them)):
        got = {(i, j): s for own in similar.similar_slabs(a, other, same, threshold) for i, j, s in zip(*own, strict=True)}
        want = {(i, j): s for i, x in enumerate(sets) for j, y in enumerate(them) if (j < i or not same) and (s := len(np.intersect1d(x, y)) / len(np.union1d(x, y))) >= threshold}
        assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_blocks_of_like_sets_are_not_multiplied_out(monkeypatch):
    """Sets of one language, few of them similar: exact products are left to where many pairs may be."""
    counted = []
    monkeypatch.setattr(similar, "_overlap", lambda a, b, shared, own=similar._overlap: counted.append(len(a.ids) * len(b.ids)) or own(a, b, shared))
    rng = np.random.default_rng(6)
    weights = 1 / (20.0 + np.arange(3000))
    sets = [np.unique(rng.choice(3000, rng.integers(150, 400), p=weights / weights.sum())) for _ in range(500)]
    sets += [s[5:] for s in sets[:20]]
    block = block_of(sets)
    found = [s for own in similar.similar_slabs(block, block, True, 0.6) for s in own[2]]
    assert len(found) >= 20 and not counted


def test_texts_of_one_language_lean_to_one_pivot(spark):
    """Blocks are cut by pivots, so as many pivots as languages keep these apart; more of them mixed languages and sizes."""
    rng = np.random.default_rng(8)
    rows = [(k, np.unique(rng.choice(300, rng.integers(60, 200)) + 1000 * (k % 3)).tolist()) for k in range(300)]
    pivots = similar._pivots(spark.createDataFrame(rows, "id long, grams array<long>"), 60)
    assert sorted(int(p.min()) // 1000 for p in pivots) == [0, 1, 2]


def test_nearest_of_blocks_where_all_are_alike(monkeypatch):
    """Where most pairs are similar, no more come out of a tile than its sets and ties, the nearest among them."""
    monkeypatch.setattr(similar, "SLAB", 64)
    monkeypatch.setattr(similar, "TILE", 128)
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.choice(200, rng.integers(150, 400))) for _ in range(400)]
    sets += [s[1:] for s in sets[:30]]
    a = block_of(sets)
    a.ids = 2 * rng.permutation(len(a.ids))
    b = block_of([s[2:] for s in sets])
    b.ids = 2 * rng.permutation(len(b.ids)) + 1
    for other, same in ((a, True), (b, False)):
        all_, some = ([np.concatenate(x) for x in zip(*((a.ids[i], other.ids[j], s) for i, j, s in similar.similar_slabs(a, other, same, 0.4, keep)), strict=True)] for keep in ("all", "nearest"))
        assert len(some[0]) < len(all_[0]) / 6
        assert all(np.array_equal(x, y) for x, y in zip(similar.nearest_of(*all_), similar.nearest_of(*some), strict=True))


def test_leaders_of_blocks_that_more_similar_earlier_ones_outdo(monkeypatch):
    """Where most pairs are similar, those come out that may be nearest among the leaders up to some time, and few others."""
    monkeypatch.setattr(similar, "SLAB", 64)
    monkeypatch.setattr(similar, "TILE", 128)
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.choice(200, rng.integers(150, 400))) for _ in range(300)]
    a, b = block_of(sets), block_of([s[k % 3 :] for k, s in enumerate(sets)])
    a.ids, b.ids = 2 * rng.permutation(300), 2 * rng.permutation(300) + 1
    every, some = ([np.concatenate(x) for x in zip(*((a.ids[i], b.ids[j], s) for i, j, s in similar.similar_slabs(a, b, False, 0.4, keep)), strict=True)] for keep in ("all", "rising"))
    assert len(some[0]) < len(every[0]) / 4
    got = set(zip(*(x.tolist() for x in similar.rising(*some)), strict=True))
    want, most = set(), {}
    for c, q, s in sorted(zip(*(every[k].tolist() for k in (1, 0, 2)), strict=True)):
        if s >= most.get(q, 0):
            want.add((q, c, s))
            most[q] = s
    assert got == want


def long_conversations(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")


def test_turns_beyond_a_thousand_keep_apart(spark, tmp_path):
    from lodestone.plans.catalogue import QUERIES

    same, other = "the lantern of the harbor is lit at night", "quartz and ember and saddle and timber"
    long_conversations(spark, tmp_path, [(5, 0, "user", other), (5, 1000, "user", same), (6, 0, "user", same), (6, 1, "user", other)])
    far = -(5 * 2**32 + 1000)
    for name in ("near_duplicates", "nearest_neighbor"):
        got = {(r.q, r.c): r.similarity for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {(6000, far): 1.0, (6001, 5000): 1.0}


def test_pairs_stay_within_a_model(spark):
    rows = [(0, "m", "the lantern of the harbor is lit"), (1, "n", "the lantern of the harbor is lit!"), (2, "m", "the lantern of the harbor was lit"), (3, "n", "the lantern of the harbor is lit!"), (4, None, "the lantern of the harbor is lit"), (5, None, "the lantern of the harbor is lit"), (6, "m", None)]
    df = spark.createDataFrame([(i, i, m, t) for i, m, t in rows], "id int, seq int, model string, text string")
    assert {(r.q, r.c) for r in similar.nearest(similar.pairs(df, 0.6)).collect()} == {(2, 0), (3, 1), (5, 4)}
    assert {(r.q, r.c) for r in similar.pairs(df, 0.6, by=None).collect()} == {(q, c) for q in range(6) for c in range(q)}


def test_shadow_compares_vectors_of_one_model(spark, tmp_path):
    from lodestone.plans.catalogue import QUERIES

    same = "the lantern of the harbor is lit at night"
    long_conversations(spark, tmp_path, [(1, 0, "user", same), (1, 1, "assistant", same), (2, 0, "user", same)])
    got = QUERIES["shadow_summary"](spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(r.n == 1 and r.safe for r in got)


def test_nearest_and_active(spark):
    index = spark.createDataFrame([("a", "How do I reset my password"), ("b", "Weather in the mountains today")], "id string, text string")
    r = similar.most_similar(spark.createDataFrame([("q", "How do I reset my password?")], "id string, text string"), index).first()
    assert r.c == "a" and r.similarity >= 0.8
    rows = spark.createDataFrame([("a", 0, "How do I reset my password", "m"), ("b", 0, "How do I reset my password?", "m"), ("c", 1, "how do I reset my password!", "m"), ("d", 1, "how do I reset my password!", "n")], "id string, seq int, text string, model string")
    got = {r.id: r.served_by for r in similar.active(rows, 0.7).collect()}
    assert got["a"] == "a" and got["b"] == "b" and got["c"] in "ab" and got["d"] == "d"


def test_retrieval_metrics(spark):
    ranking = spark.createDataFrame([(1, "x", 0.9, 1), (1, "y", 0.8, 2), (1, "z", 0.7, 3)], "qid int, id string, score double, rank int")
    qrels = spark.createDataFrame([(1, "y", 1), (1, "w", 1)], "query_id int, doc_id string, relevance int")
    import math

    assert abs(retrieval.ndcg(ranking, qrels).first().ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-12
    assert retrieval.recall(ranking, qrels).first().recall == 0.5


def test_search_sets_every_hundredth_row_against_all_others(spark, small):
    from lodestone.plans.catalogue import QUERIES
    from lodestone.sources import tables

    ids = {r.id for r in tables.vectors(spark, small).select("id").collect()}
    got = QUERIES["cosine_argmax_all"](spark, small).collect()
    assert {r.qid for r in got} == {i for i in ids if i % 100 == 0} and all(r.qid != r.id for r in got)
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id int, v array<double>")
    got = retrieval.rank(rows.select(F.col("id").alias("qid"), "v"), rows, 9, others=True).collect()
    assert {(r.qid, r.id) for r in got} == {(q, i) for q in range(5) for i in range(5) if q != i}


@pytest.mark.parametrize("broadcast", [True, False])
def test_search_in_many_blocks(spark, monkeypatch, broadcast):
    """Rows that point alike, copies, rows of length 0, other dimensions and rows without a vector, against a plain search."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 8)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 16)
    monkeypatch.setattr(retrieval, "PIVOTS", 6)
    if not broadcast:
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(9, 6))
    v = [(centers[i % 9] + 0.05 * rng.normal(size=6)).tolist() for i in range(500)]
    v += [v[3]] * 40 + [[0.0] * 6] * 3 + [[1.0, 2.0], [2.0, 1.0], [1.0, None], [], None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v array<double>")
    got = retrieval.rank(rows.where("id % 5 = 0 OR id >= 538").select(F.col("id").alias("qid"), "v"), rows, 7, others=True).collect()
    whole = [(i, x) for i, x in enumerate(v) if x and None not in x]
    unit = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, x in whole}
    want = []
    for q in (i for i, _ in whole if i % 5 == 0 or i >= 538):
        near = sorted((-round(float(unit[q] @ unit[i]), 12) or 0.0, i) for i in unit if i != q and len(unit[i]) == len(unit[q]))[:7]
        want += [(q, k + 1, i) for k, (_, i) in enumerate(near)]
    assert sorted((r.qid, r["rank"], r.id) for r in got) == sorted(want)


def test_search_without_rows(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    for q, c in ((none, one), (one, none), (none, none)):
        assert retrieval.rank(q.withColumnRenamed("id", "qid"), c, 3).columns == ["qid", "id", "score", "rank"]
        assert retrieval.rank(q.withColumnRenamed("id", "qid"), c, 3).count() == 0


def plain_cuts(data, least, average, most):
    import hashlib

    gear = [int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)]
    bits = average.bit_length() - 1
    strict, loose, ends, at = (1 << (bits + 2)) - 1, (1 << (bits - 2)) - 1, [], 0
    while at < len(data):
        rest = data[at:]
        end = min(len(rest), most)
        if len(rest) > least:
            h = 0
            for i in range(least, end):
                h = ((h << 1) + gear[rest[i]]) % 2**64
                if h & (strict if i < min(average, end) else loose) == 0:
                    end = i + 1
                    break
        at += end
        ends.append(at)
    return ends


@pytest.mark.parametrize("sizes", [(200, 800, 2000), (100, 400, 1000), (16, 64, 128)])
def test_content_chunks(sizes):
    rng = random.Random(8)
    for n in (0, 5, 16, 17, 900, 20000):
        data = bytes(rng.randrange(256) for _ in range(n))
        cutter = chunking.Cutter(*sizes)
        assert cutter.cuts(data) == plain_cuts(data, *sizes)
        parts = cutter.split(data)
        assert b"".join(p["data"] for p in parts) == data and all(p["size"] <= sizes[2] for p in parts)


def test_edits_stay_local(spark, small):
    from lodestone.sources.tables import edited_documents

    docs = edited_documents(spark, small).where("doc_id % 20 = 0 AND length(before) > 4000")
    share = lambda f: chunking.difference(*(chunking.exploded(docs, f(F.col(c)), "doc_id").drop("data") for c in ("before", "after")), ["doc_id"]).agg(F.sum("unchanged") / F.sum("total")).first()[0]
    content, fixed = share(chunking.content_chunks), share(chunking.fixed_chunks)
    assert content >= 0.5 and content > fixed


def test_pack_paragraphs():
    text = "== Heading\n" + "word " * 200 + "\n\nshort\n" + "x" * 1200
    parts = chunking.pack(text)
    assert all(150 <= len(p.encode()) <= 501 for p in parts) and not any("==" in p for p in parts)


def test_mock_vectors(spark):
    v = mock.vector("m", "text", 20)
    assert len(v) == 20 and v.dtype == "float32" and abs(v).max() <= 1 and (mock.vector("m", "text", 9) == v[:9]).all()
    df = spark.createDataFrame([("m", "text")], "m string, t string").select(mock.embed(F.col("m"), F.col("t"), 20).alias("v"))
    assert df.select(mock.floats_of_base64(mock.base64_floats("v"))).first()[0] == df.first().v


def test_percentiles_are_values(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10)], "v double")
    assert ledger.rank_floor_percentiles(df, "v", {"p": 0.95}).first().p == 8.0


def test_workloads(spark):
    draws = mock.zipf(spark, 2000, 50).groupBy("rank").count().orderBy("rank").collect()
    assert draws[0]["count"] > draws[-1]["count"]
    assert mock.corpus(spark, 3, 5).select(F.size(F.split("text", " ")).alias("n")).where("n <> 5").count() == 0


@pytest.mark.parametrize("meetings", [0, 10**9])
def test_nearest_earlier_gathers_no_pairs(spark, monkeypatch, meetings):
    """What comes back of two blocks grows with their sets, not with their similar pairs, and is the nearest of all pairs."""
    monkeypatch.setattr(similar, "MEETINGS", meetings)
    monkeypatch.setattr(similar, "GRID", 64)
    words = "stone river paper light winter engine".split()
    texts = [" ".join(words[(k * 7 + j) % (3 + k % 4)] for j in range(6)) + f" {k % 90}" for k in range(200)]
    rows = spark.createDataFrame([(k, k, t, "mn"[k % 2]) for k, t in enumerate(texts)], "id long, seq long, text string, model string")
    for by in ("model", None):
        want = similar.nearest(similar.pairs(rows, 0.4, by=by))
        got = similar.nearest_earlier(rows, 0.4, by=by)
        assert sorted(map(tuple, got.collect())) == sorted((r.q, r.c, r.similarity) for r in want.collect())
    q, c, s = similar.nearest_of(np.array([5, 1, 9, 5]), np.array([2, 5, 5, 3]), np.array([0.5, 0.5, 0.7, 0.4]))
    assert (q.tolist(), c.tolist(), s.tolist()) == ([5, 9], [1, 5], [0.5, 0.7])


def test_active_by_runs_of_sets_matches_all_pairs(spark, monkeypatch):
    """Leaders are found without all pairs where prefixes meet everywhere: ties of seq, copies, ids that come again, no text."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["red", "green", "blue", "cyan", "grey", "pink"]) for _ in range(rng.randrange(1, 9))) for _ in range(150)] + ["", None, "red red"]
    made = [(str(k % 140), k // 2, t, rng.choice("mn")) for k, t in enumerate(texts + texts[:30])]
    rows = spark.createDataFrame(made, "id string, seq int, text string, model string")
    monkeypatch.setattr(similar, "GRID", 16)
    got = []
    for meetings, most in ((0, 0), (10**9, 0), (0, 5), (10**9, 5)):
        monkeypatch.setattr(similar, "MEETINGS", meetings)
        paired = []
        monkeypatch.setattr(similar, "pairs", lambda *a, own=similar.pairs, **k: paired.append(1) or own(*a, **k))
        got.append(sorted((r.id, r.served_by, round(r.similarity, 9)) for r in similar.active(rows, 0.5, most_keys=most).collect()))
        monkeypatch.undo()
        monkeypatch.setattr(similar, "GRID", 16)
        assert bool(paired) == (meetings > 0)
    assert got[0] == got[1] and got[2] == got[3] and any(a != b for a, b, _ in got[0])


def test_chunks_and_vectors_come_in_small_parts():
    """A batch of very many texts is never held in Python as a whole, neither its texts nor what is made of them."""
    import pyarrow as pa

    texts = ["", None, "x" * 3000, "漢字" * 500, *("stone river paper " * (k % 40) for k in range(1000))]
    parts = list(chunking.place_batches()(iter([pa.array(texts), pa.array([], pa.string())])))
    assert max(map(len, parts)) <= chunking.AT_ONCE and sum(map(len, parts)) == len(texts)
    cutter = chunking.Cutter()
    assert [[tuple(c.values()) for c in own] for p in parts for own in p.to_pylist()] == [[] if t is None else cutter.places(t.encode()) for t in texts]


def test_coupled_budget_folds_few_rows(spark, monkeypatch):
    """Against one by one in Python; what is surely let through keeps its key's later rows out of the one task."""
    rng = random.Random(3)
    made = [(k, rng.choice(["a", "b", None]), rng.randrange(3), f"k{rng.randrange(60)}", rng.randrange(1, 9), (30, 0, 4)[k % 3]) for k in range(400)]
    cached, spent, want = set(), {}, {}
    for seq, caller, win, key, tokens, limit in made:
        ok = key not in cached and (limit <= 0 or spent.get((caller, win), 0) < limit)
        want[seq] = "hit" if key in cached else "miss" if ok else "refused"
        if ok:
            spent[caller, win] = spent.get((caller, win), 0) + tokens
            cached.add(key)
    folded = []
    own = replay.in_order
    monkeypatch.setattr(replay, "in_order", lambda rows, *a: folded.append(rows.count()) or own(rows, *a))
    rows = spark.createDataFrame(made, "seq long, caller string, win long, key string, tokens long, token_limit long")
    assert {r.seq: r.outcome for r in replay.coupled_budget(rows).collect()} == want
    assert set(want.values()) == {"hit", "miss", "refused"} and folded[0] < 200
