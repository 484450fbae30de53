"""Operators against SQL, brute force, round trips and held-out rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import boosting, chat, decontaminate, html_text, licenses, mixing, sharding, simhash, tokens_out, topk, toxicity
from lodestone.llm.common import table
from lodestone.llm.labelled_pages import labelled_pages
from lodestone.llm.license_rules import CONFIDENCE, rules


def same(df, frame):
    got = df.toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(frame.columns)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("limit", [sharding.SHARD_BYTES, 20_000])
def test_sharding(spark, small, sql, limit):
    same(sharding.op1_sharding(table(spark, small, "documents"), limit), sql.execute(sharding.oracle(limit)).fetchdf())


def test_sharding_of_one_key(spark):
    rows = spark.range(2000).selectExpr("'same' AS doc_id", "'0123456789' AS text").union(spark.range(50).selectExpr("cast(id AS string)", "repeat('a', 3000)"))
    got = sharding.op1_sharding(rows, 1000).toPandas()
    assert len(got) == 2050 and (got[got.shard_docs > 1].shard_bytes <= 1000).all()
    assert (got.groupby("shard").n_bytes.sum() == got.groupby("shard").shard_bytes.first()).all()


def test_topk(spark, small, sql):
    same(topk.op2_topk(table(spark, small, "embeddings")), sql.execute(topk.ORACLE_SQL).fetchdf())


def test_topk_with_uneven_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 128)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    v = [(base[i % 12] + 0.05 * rng.normal(size=16)) * np.exp(rng.normal()) for i in range(1500)]
    v[20] = v[40]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    a = np.floor(64 * np.array(v)).astype(np.int64)
    s = a @ a.T
    want = [(q, k + 1, c, t) for q in range(0, 1500, 20) for k, (t, c) in enumerate([(-x, c) for x, c in sorted((-s[q, c], c) for c in range(1500) if c != q)][:20])]
    assert sorted(tuple(r) for r in topk.op2_topk(df).collect()) == sorted(want)


def near_pruning():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, 8))
    return rng, topk.Bucket(np.arange(400), rows[np.argsort(-np.linalg.norm(rows, axis=1))])


def test_coordinate_pruning_loses_nothing():
    rng, bucket = near_pruning()
    for t in (0.3, 0.6, 0.9):
        for _ in range(30):
            q = rng.normal(size=8)
            cos = bucket.rows @ q / (bucket.norms * np.linalg.norm(q))
            assert set(np.flatnonzero(cos >= t)) <= set(bucket.near(q, np.linalg.norm(q), t))


def classes(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(sorted(root), 2):
        if bin(a ^ b).count("1") <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in root}


@pytest.mark.parametrize("crowd", [500, 1])
def test_simhash(spark, small, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    docs = table(spark, small, "documents")
    fp = {r.doc_id: simhash.simhash((r.text or "").encode()) for r in docs.collect()}
    found = classes(set(fp.values()))
    first = {}
    for i, f in sorted(fp.items()):
        first.setdefault(found[f], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(docs).collect()}
    assert got == {i: (f"{f:016x}", first[found[f]]) for i, f in fp.items()}


def test_simhash_definition():
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d")]
    assert simhash.simhash(b" A b\tc  D ") == hashes[0] & hashes[1]
    assert simhash.simhash(b"Solo two") == xxhash.xxh64_intdigest(b"solo two", 42) and simhash.simhash(b" \n") == 0


def test_links_in_crowds(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 3)
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = {s for s in seeds} | {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for s in seeds for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}


def test_components_of_a_long_chain(spark):
    chain = list(range(200))
    random.Random(1).shuffle(chain)
    edges = [tuple(sorted(p)) for p in zip(chain, chain[1:], strict=False)]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.root for r in got} == {0} and len(got) == 200


def scan_plainly(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places, base = [], set()
    for phrase, label in licenses.BASE:
        own = phrase.split()
        hits = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        places += hits
        base |= {label} if hits else set()
    norm, found = f" {' '.join(words)} ", []
    for n, (label, tier, keyword, rx) in enumerate(rules()):
        if keyword in norm:
            for m in re.finditer(f"(?<= )(?:{rx})(?= )", norm):
                start = norm[: m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" ") + 1, tier, n, label))
    kept = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and (e[2], -(e[1] - e[0]), e[3]) < (d[2], -(d[1] - d[0]), d[3]) for e in found)]
    score = CONFIDENCE[min(d[2] for d in kept)] if kept else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in kept})), score


def test_licences(spark, small):
    text = 'Licensed under the Apache License, Version 2.0 (the "License"). GNU Lesser General Public License, version 2.1 or any later version. MIT license mit license MIT-License; CC-BY-NC-SA 4.0; cc by cc by. GNU General Public License, version 3. SPDX-License-Identifier: GPL-2.0-or-later Copyright (c) 2020 '
    own = spark.createDataFrame([(-1, text), (-2, None), (-3, "..."), (-4, text * 20), (-5, "Kcc by MIT LİCENSE")], "doc_id long, text string")
    docs = table(spark, small, "documents").select("doc_id", "text").union(own)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.op4_licenses(docs).collect():
        assert tuple(r)[1:] == scan_plainly(texts[r.doc_id]), r.doc_id


def test_rules_are_many_and_valid():
    found = rules()
    assert len(found) >= 200 and all(re.compile(r[3]) and r[1] < len(CONFIDENCE) for r in found)


def test_toxicity_on_held_out_documents(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    got = toxicity.op5_toxicity(docs, labels).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.y).mean() > 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_held_out_rule(spark):
    got = {r.id: r.h for r in spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.BoostedTrees().fit(x[:600], y[:600])
    assert ((m.margin(x[600:]) > 0) == y[600:]).mean() > 0.9
    iso = boosting.Isotonic().fit(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(iso(np.linspace(0, 5, 50))) >= 0).all() and iso(np.array([9.0]))[0] == 1


def test_token_files(spark, small, odd_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens_out.vocabulary_path())
    for docs in (table(spark, small, "documents"), odd_docs):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        want, at = [], 0
        for r in rows:
            ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(map(tuple, tokens_out.op6_token_output(docs).collect()), key=lambda r: r[1]) == want


def plain_cost(roles):
    best = {"start": 0}
    for role in map(chat._known, roles):
        new = {}
        for s, c in best.items():
            ways = [(s, chat.MERGE + chat._relabel_cost(role, s))] if s != "start" else []
            for n in range(4):
                for seq in itertools.product(("system", "user", "assistant"), repeat=n + 1):
                    if all(b in chat.NEXT[a] for a, b in zip((s, *seq), seq, strict=False)):
                        ways.append((seq[-1], chat.INSERT * n + chat._relabel_cost(role, seq[-1])))
            for t, k in ways:
                new[t] = min(new.get(t, 1 << 60), c + k)
        best = new
    return min(c + chat._END_COST[chat.STATES.index(s)] for s, c in best.items())


@pytest.mark.parametrize("most", [4096, 7])
def test_role_repair(spark, most):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", None, "Human"]), f"t{t} <|x|>" if t % 3 else None) for c in range(30) for t in range(rng.randint(1, 7) if c else 200)]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most).toPandas()
    for c, own in got.groupby("conv_id"):
        own = own.sort_values("pos")
        text = "".join(own.rendered)
        marks = re.findall(r"<\|(system|user|assistant)\|>", text)
        for a, b in zip(("start", *marks), marks, strict=False):
            assert b in chat.NEXT[a]
        assert marks[-1] == "assistant" and text.count("<|end|>") == len(marks) and "<|x|>" not in text
        turns = own.iloc[:-1]
        cost = sum(chat._relabel_cost(chat._known(r), n) for r, n in zip(turns.role, turns.new_role, strict=True)) + chat.MERGE * (turns.action == "merge").sum()
        cost += chat.INSERT * (len(marks) - (turns.action != "merge").sum())
        assert cost == plain_cost(turns.role) and list(own.pos) == list(range(len(own))), c


def test_decontamination(spark, small, sql):
    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark")
    same(decontaminate.op8_decontaminate(docs, bench), sql.execute(decontaminate.ORACLE_SQL).fetchdf())
    item = bench.first().text
    hidden = item.upper().replace(" ", " -- ")
    words = item.split()
    partly = " ".join(words[: int(len(words) * 0.95)]) + " other words follow here in place of it"
    planted = spark.createDataFrame([(1, "before it " * 3000 + hidden + " after it" * 3000), (2, partly), (3, " ".join(words[: len(words) // 2]))], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.contained(planted, bench).collect()} == {1, 2}


def test_page_model_on_pages_it_has_not_seen():
    chain = html_text.train(labelled_pages())
    wrong = total = 0
    for html, labels in labelled_pages(150, 99):
        got = chain.decode(html_text._features(html_text.leaf_blocks(html)))
        total += len(labels)
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
    assert wrong < 0.01 * total


def test_pages_of_the_table(spark, small):
    import html as entities

    pages = table(spark, small, "pages")
    htmls = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.op9_html(pages).collect():
        body = htmls[r.page_id].split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    chain = html_text.Chain(rng.normal(size=(6, 2)), rng.normal(size=(2, 2)))
    rows = [list(rng.choice(6, 2, replace=False)) for _ in range(7)]
    score = lambda path: sum(chain.weights[r, y].sum() for r, y in zip(rows, path, strict=True)) + sum(chain.steps[a, b] for a, b in zip(path, path[1:], strict=False))
    assert tuple(chain.decode(rows)) == max(itertools.product((0, 1), repeat=7), key=score)


def test_mixing(spark, small, sql):
    got = mixing.op10_mixing(table(spark, small, "documents"))
    same(got, sql.execute(mixing.ORACLE_SQL).fetchdf())
    assert sorted(got.collect()) == sorted(mixing.op10_mixing(table(spark, small, "documents")).collect())


def test_targets():
    t = mixing.source_targets([("b", 100), ("a", 10), (None, 50)])
    assert t == {"a": 20.0, "b": 136.66666666666666, None: 68.33333333333333} or abs(sum(t.values()) - 240) < 1e-9
    assert all(t[s] <= 2 * n + 1e-9 for s, n in (("a", 10), ("b", 100), (None, 50)))


def test_flow_of_overlapping_sources():
    patterns = [(("a",), 10), (("a", "b"), 10), (("b",), 2)]
    flows = mixing.route(patterns, {"a": 10, "b": 12})
    assert sum(flows) == 22 and all(f <= 2 * n for f, (_, n) in zip(flows, patterns, strict=True))
    assert flows == [10, 10, 2]  # no second copy while first copies do
    assert sum(mixing.route(patterns, {"a": 10, "b": 24})) == 34
