"""Hot keys, long inputs, several rounds and blocks, and clashing names."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, common, decontaminate, html_text, licenses, mixing, sharding, simhash, tokens_out, topk, toxicity
from lodestone.llm.common import table


def quickly(f, seconds=20):
    began = time.time()
    out = f()
    assert time.time() - began < seconds
    return out


@pytest.mark.parametrize("piece", ["<a ", "<!-- ", "<script>", "<a href=\"' ", "</ "])
def test_pages_of_ten_megabytes(piece):
    quickly(lambda: html_text.leaf_blocks("<p>start</p>" + piece * (10_000_000 // len(piece))))


@pytest.mark.parametrize("piece", ["<svg>", "<div>x", "<b>x", "<div>x</div>"])
def test_pages_of_very_many_tags(piece):
    quickly(lambda: html_text.leaf_blocks("<p>start</p>" + piece * (1_000_000 // len(piece))))


def test_scripts_do_not_part_a_block():
    texts = lambda h: [b.text for b in html_text.leaf_blocks(h)]
    assert texts("<p>foo <script>x</script>bar</p>") == ["foo bar"]
    assert texts("<p>a<style>p{}</style>b <svg><text>no</text></svg>c<p>d") == ["ab c", "d"]
    assert texts("<p title='a>b'>x</p>y<svg>z") == ["x", "yz"] and texts("a < b &lt; <3") == ["a < b < <3"]


def test_many_licences_in_one_document(spark):
    docs = spark.createDataFrame([(1, "mit license " * 50_000), (2, "MIT License\n" * 3)], "doc_id int, text string")
    got = {r.doc_id: r for r in quickly(lambda: licenses.op4_licenses(docs).collect(), 90)}
    assert (got[1].n_base, got[1].last_word, got[1].base_labels) == (50_000, 99_998, "mit") and got[2].n_base == 3
    kept = licenses.scan(docs.where("doc_id = 2"), F.col("text")).first()["_kept"]
    assert [(d.start, d.stop) for d in kept if d.label == "mit"] == [(0, 2), (2, 4), (4, 6)]


def test_bare_identifiers(spark):
    texts = ["under GPL-3.0", "LGPL-2.1-or-later", "AGPLv3", "MPL-2.0.", "EPL-2.0", "Apache-2.0", "GPL v2 only", "simple apple"]
    got = [r.labels for r in licenses.op4_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == ["gpl-3.0", "lgpl-2.1", "agpl-3.0", "mpl-2.0", "epl-2.0", "apache", "gpl-2.0", ""]


def test_directory_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 3)
    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat('a', 10) AS text", "'x' AS shard", "1 AS _hash", "2 AS bytes")
    sized = rows.select(F.lit(0).cast("long").alias("own"), sharding.key_hash(F.col("doc_id")).alias("hash"), F.lit(10).cast("long").alias("bytes"))
    tables, full = sharding.directory(sized, 200)
    assert len(tables) >= 3 and full.isEmpty()
    got = sharding.assign(rows, F.col("doc_id"), F.octet_length("text"), 200)
    assert got.columns == ["doc_id", "text", "_hash", "bytes", "shard", "depth", "row_bytes"]
    sizes = {r.shard: r.s for r in got.groupBy("shard").agg(F.sum("row_bytes").alias("s")).collect()}
    assert sum(sizes.values()) == 30_000 and max(sizes.values()) <= 200 and len(sizes) > 150
    for s in sizes:  # its sibling and it would not fit together, else the split was not needed
        sibling = s[:-1] + ("1" if s[-1] == "0" else "0")
        together = sum(n for t, n in sizes.items() if t.startswith(s[:-1]))
        assert together > 200, (s, sibling)


def test_overflow_of_several_keys(spark):
    rows = spark.range(4000).selectExpr("concat('k', id % 2) AS doc_id", "'0123456789' AS text")
    got = sharding.op1_sharding(rows, 500).toPandas()
    assert len(got) == 4000 and got.shard_bytes.max() <= 500 and got.shard.str.contains("-").all()


def test_written_shards(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS doc_id", "repeat('a', 20) AS text")
    sharding.write_shards(rows, str(tmp_path / "out"), F.col("doc_id"), F.octet_length("text"), 1000)
    want = {("s" + r.shard): r.s for r in sharding.assign(rows, F.col("doc_id"), F.octet_length("text"), 1000).groupBy("shard").agg(F.sum("row_bytes").alias("s")).collect()}
    for reader in (spark.read, spark.read.schema("doc_id long, text string, depth int, row_bytes long, shard string")):
        back = reader.parquet(str(tmp_path / "out"))
        sizes = {r.shard: r.s for r in back.groupBy("shard").agg(F.sum("row_bytes").alias("s")).collect()}
        assert back.count() == 500 and sizes == want and len(sizes) >= 10 and max(sizes.values()) <= 1000


def test_many_shards_and_buckets_of_small_tables(spark, small):
    shards = sharding.op1_sharding(table(spark, "/root/testdata/sf0.01", "documents")).select("shard").distinct().count()
    assert shards > 20
    vectors = table(spark, small, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("v")).withColumns({"dim": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))})
    assert topk.buckets(vectors, topk.LEAST).count() >= 5


@pytest.mark.parametrize("broadcast", [True, False])
def test_search_in_several_blocks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1200, 8)) * np.exp(rng.normal(size=(1200, 1)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    a = np.floor(64 * v).astype(np.int64)
    s = a @ a.T
    want = [(q, k + 1, c, t) for q in range(0, 1200, 20) for k, (t, c) in enumerate([(-x, c) for x, c in sorted((-s[q, c], c) for c in range(1200) if c != q)][:20])]
    assert sorted(tuple(r) for r in topk.op2_topk(df).collect()) == sorted(want)


def test_blocks_of_like_need(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    queries = spark.createDataFrame([(i, [float(1 + i % 7), 1.0], 2, float(i) if i % 3 else None) for i in range(100)], "vec_id long, v array<double>, dim int, floor double")
    blocks = topk._blocks(queries, 100).collect()
    assert len(blocks) > 3 and sum(len(r.q_ids) // 8 for r in blocks) == 100


def test_thousands_of_blocks(spark, monkeypatch):
    """The plan does not grow with the blocks."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    queries = spark.range(10_000).selectExpr("id AS vec_id", "array(1.0D, 0.0D) AS v", "2 AS dim", "double(id % 7000 + 1) AS floor")
    began = time.time()
    blocks = topk._blocks(queries, 10_000).select("block", "least", (F.octet_length("q_ids") / 8).alias("n")).collect()
    assert time.time() - began < 60 and len(blocks) > 3000 and sum(r.n for r in blocks) == 10_000
    by_block = [r.least for r in sorted(blocks, key=lambda r: r.block)]
    assert by_block == sorted(by_block)


def test_places_of_a_need(spark):
    cuts = [-float("inf"), 0.0, 0.5, 0.5, 2.0, 1e300]
    needs = [-float("inf"), -1.0, 0.0, 0.25, 0.5, 1.0, 2.0, 3.0, 1e300, float("inf")]
    rows = spark.createDataFrame([(x,) for x in needs], "need double").select("need", *[c.alias(n) for c, n in zip(topk._below(F.col("need"), cuts), "ab", strict=True)]).collect()
    assert [(r.a, r.b) for r in rows] == [(sum(c < x for c in cuts), sum(c <= x for c in cuts)) for x in needs]


@pytest.mark.parametrize("kind", ["json", "csv", "orc", "parquet", "partitioned", "view"])
def test_filters_on_other_sources(spark, small, tmp_path, kind):
    """Rows of any source are told apart."""
    base = table(spark, small, "documents").limit(60).unionByName(table(spark, small, "documents").limit(5))
    path = str(tmp_path / kind)
    if kind == "partitioned":
        base.write.partitionBy("lang").parquet(path)
        docs = spark.read.parquet(path)
    elif kind == "view":
        base.write.parquet(path)
        spark.read.parquet(path).createOrReplaceTempView("some_docs")
        docs = spark.table("some_docs")
    else:
        write = base.write.option("escape", '"').option("quoteAll", True) if kind == "csv" else base.write
        write.format(kind).save(path)
        docs = spark.read.option("multiLine", kind == "csv").option("escape", '"').schema(base.schema).format(kind).load(path)
    rows, names = common.numbered(docs)
    assert rows.count() == rows.select(*names).distinct().count() == 65
    labels, bench = table(spark, small, "labels"), table(spark, small, "benchmark")
    assert 0 < toxicity.without_toxic(docs, labels).count() <= 65
    assert 0 < simhash.keep_one(docs).count() <= 60
    assert 0 < decontaminate.without_leaks(docs, bench).count() <= 65
    assert 0 < mixing.mix_documents(docs).count() <= 130
    assert tokens_out.op6_token_output(docs).count() == 65


def test_rows_dropped_by_bitmaps(spark, small, tmp_path, monkeypatch):
    """However many rows are dropped, the texts of the others are not shuffled, and the same rows stay."""
    table(spark, small, "documents").repartition(5).write.parquet(str(tmp_path / "docs"))
    docs, labels, bench = spark.read.parquet(str(tmp_path / "docs")), table(spark, small, "labels"), table(spark, small, "benchmark")
    filters = {"toxic": lambda: toxicity.without_toxic(docs, labels), "copies": lambda: simhash.keep_one(docs), "leaks": lambda: decontaminate.without_leaks(docs, bench)}
    want = {name: sorted(r.doc_id for r in make().collect()) for name, make in filters.items()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    for name, make in filters.items():
        got = make()
        assert sorted(r.doc_id for r in got.collect()) == want[name] and len(want[name]) < 200
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    rows, names = common.numbered(spark.range(100_000).selectExpr("id", "id % 3 = 0 AS gone"))
    left = common.without_rows(rows, names, rows.where("gone").select(*names))
    assert left.count() == 66_666 and left.where("gone").isEmpty()
    assert common.without_rows(rows, names, rows.where("false").select(*names)).count() == 100_000


def test_one_id_with_a_third_of_all_rows(spark, monkeypatch):
    rows = [(7 if i % 3 == 0 else i, f"word{i % 5} " * (1 + i % 4), "s" if i % 2 else "t") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {k: Counter() for k in ("loose", "tight")}
    for name, most in (("loose", 10_000), ("tight", 3)):
        monkeypatch.setattr(mixing, "CUT_ROWS", most)
        got = mixing.op10_mixing(docs).collect()
        plain[name] = Counter((r.doc_id, r["size"], r.taken) for r in got)
        assert len(got) == 900 and all(r.taken <= 2 * r["size"] for r in got)
        for source in {r.target for r in got}:
            own = [r for r in got if r.target == source]
            assert abs(sum(r.taken for r in own) - source) <= 4
    assert plain["loose"] == plain["tight"]
    monkeypatch.setattr(tokens_out, "PART_BYTES", 400)
    out = sorted(tokens_out.op6_token_output(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(r[0] for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(out))


def test_ranges_cut_an_id(spark, monkeypatch):
    monkeypatch.setattr(tokens_out, "PART_BYTES", 2000)
    docs = spark.createDataFrame([(5, f"text number {i}") for i in range(2000)], "doc_id long, text string")
    parts = tokens_out.write_tokens(docs, f"{common.shared_dir(spark)}/cut", tokens_out.vocabulary_path())
    sizes = [p["n_docs"] for p in parts]
    assert sum(sizes) == 2000 and len(sizes) > 5 and max(sizes) < 1000


def test_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(20)]
    rows = [(i, texts[0] if i % 2 else texts[i % 20]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert {r.doc_id: r.component_id for r in simhash.op3_simhash(docs).collect()} == {i: first[t] for i, t in rows}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(first.values())


def test_thinned_links_join_the_same(spark):
    rng = random.Random(6)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for s in seeds for _ in range(80)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    every, few = simhash.links(df).collect(), simhash.links(df, thin=True).collect()
    assert set(few) <= set(every) and len(few) < len(every) / 2

    def classes(edges):
        up = {f: f for f in signed}
        for _ in range(len(signed)):
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert classes(every) == classes(few)


def test_names_that_operators_use_themselves(spark):
    names = "_score score _row _n _kept _leak _file _at _f _a file at digest fp _bytes _size _members _copies _copy row members size path copies".split()
    words = [f"alpha{i} beta{i} gamma{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 5 :]), "s", *[f"{n}{i}" for n in names]) for i in range(10)], ", ".join(["doc_id long", "text string", "source string", *[f"{n} string" for n in names]]))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, " ".join(words[4:]))], "item_id long, text string")
    clean = toxicity.without_toxic(docs, labels.where("toxic = 0"))
    once = simhash.keep_one(docs)
    left = decontaminate.without_leaks(docs.where("doc_id > 100").unionByName(docs), spark.createDataFrame([(1, "no such words in any text here")], "item_id long, text string"))
    mixed = mixing.mix_documents(docs)
    n_classes = simhash.op3_simhash(docs).select("component_id").distinct().count()
    for got, n in ((clean, 10), (once, n_classes), (left, 10)):
        assert got.columns == docs.columns and got.count() == n
        assert all(r._file == f"_file{r.doc_id}" and r.score == f"score{r.doc_id}" and r.path == f"path{r.doc_id}" for r in got.collect())
    assert mixed.columns == docs.columns and all(r.copies == f"copies{r.doc_id}" for r in mixed.collect())
    assert decontaminate.without_leaks(docs, bench).count() == 0
    assert sharding.assign(docs, F.col("doc_id"), F.octet_length("text")).count() == 10


def test_items_of_all_widths_in_one_pass(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 14, 30, 60, 80])]
    docs = []
    for d in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))]
        own = rng.choice(items)[1].split()
        for _ in range(rng.randrange(3)):  # a copy with a few words changed
            own[rng.randrange(len(own))] = "changed"
        at = rng.randrange(len(text))
        docs.append((d, " ".join(text[:at] + own + text[at:])))

    def shingles(text, n):
        w = text.split()
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        n = min(5, len(item.split()))
        own = shingles(item, n)
        shared = len(own & shingles(text, n))
        if shared >= -(-8 * len(own) // 10):
            want[d, i] = shared
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.n_shared for r in got.collect()} == want and len(want) > 50


def test_blocks_of_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_BYTES", 1000)
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", "x" * 300) for t in range(50)], "conv_id long, turn long, role string, text string")
    rows = [r for r in turns.toPandas().assign(text="x" * 300).to_dict("records")]
    import pandas as pd

    class Part:
        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: Part))
    chunks = [len(c) for c in chat._cut(4096)(iter([pd.DataFrame(rows)]))]
    assert sum(chunks) == 50 and max(chunks) <= 3
    monkeypatch.undo()
    monkeypatch.setattr(chat, "BLOCK_BYTES", 1000)
    got = chat.repair(turns, 7).toPandas().sort_values("pos")
    assert list(got.action) == ["keep"] * 50 + ["close"] and list(got.pos) == list(range(51))


def plain_features(text, lexicon):
    """The features of a text, each counted in the most direct way."""
    words = re.findall(r"[^\W_]+", text.lower())
    n, chars = max(len(words), 1), max(len(text), 1)
    kinds = [[w for w in words if w in own.split()] for own in toxicity.WRITTEN.values()]
    # A word of several kinds counts as the last one's.
    kinds = [[w for w in own if not any(w in later for later in [x.split() for x in list(toxicity.WRITTEN.values())[k + 1 :]])] for k, own in enumerate(kinds)]
    weight = {w: max([lexicon.get(w + "$", 0.0), *[lexicon.get(w[:k], 0.0) for k in (3, 4, 5, 6)]]) for w in set(words)}
    hit = [w for w in words if weight[w]]
    top = sorted((weight[w] for w in set(hit)), reverse=True)
    marked = [bool(weight[w]) or any(w in own for own in kinds) for w in words]
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = sum(m and any(abs(i - j) <= 3 for j in second) for i, m in enumerate(marked))
    masked = toxicity._MASKED.findall(text)
    undone = sum(1 for m in masked if (w := "".join(re.findall(r"[^\W_]+", m.lower().translate(toxicity._UNMASK)))) in toxicity._KINDS or w + "$" in lexicon)
    return [
        *(len(k) / n for k in kinds), *(np.log1p(len(k)) for k in kinds), len(hit) / n, np.log1p(len(hit)), len(set(hit)), top[0] if top else 0, top[1] if len(top) > 1 else 0, sum(weight[w] for w in hit) / n, sum(top[:20]),
        near / n, near, sum(c.isupper() for c in text) / chars, sum(len(w) > 2 and w.isupper() for w in text.split()) / n, text.count("!") / chars, text.count("?") / chars, len(re.findall(r"!{2,}|\?{2,}", text)) / n,
        len(masked) / n, undone, undone / n, np.log1p(len(words)), len(set(words)) / n,
    ]


def test_toxicity_features_and_trees(spark, small):
    lexicon = {"idi": 1.5, "mor": 0.5, "hello$": 2.0, "trash$": 1.0}
    texts = [r.text or "" for r in table(spark, small, "documents").limit(60).collect()]
    texts += ["", "YOU are an IDIOT!! m0ron you tr4sh... hello hello??", "tu es un crétin, v.e.r.m.i.n 1d1ot", "Ünïcode ß ÇA VA", "!!! ???"]
    for t in texts:
        assert np.allclose(toxicity.features(t, lexicon), plain_features(t, lexicon)), t[:80]


def test_lexicon_counts(spark):
    rows = [(1, "bad worse bad", 1, 0), (2, "bad good", 0, 0), (3, "worse", 1, 1), (4, None, 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int, fold int")
    names = [f"c{k}" for k in range(2 * toxicity.FOLDS)]
    got = {r.unit: tuple(r)[1:5] for r in df.mapInPandas(toxicity._count_units, "unit string, " + ", ".join(f"{c} long" for c in names)).groupBy("unit").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    assert got["bad$"] == (1, 1, 0, 0) and got["worse$"] == (0, 1, 0, 1) and got["wors"] == (0, 1, 0, 1) and got["good$"] == (1, 0, 0, 0)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Far:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1000]"

    with pytest.raises(ValueError):
        common.shared_dir(Far)


def test_rows_are_told_apart_wherever_they_come_from(spark, small):
    docs = table(spark, small, "documents")
    for df in (docs, docs.select("doc_id", "lang"), docs.where("doc_id > 5"), docs.union(docs), docs.withColumn("_at", F.lit(1))):
        rows, names = common.numbered(df)
        assert rows.select(*names).distinct().count() == df.count() and set(df.columns) <= set(rows.columns)
