"""Every operator on empty tables and on odd rows."""

import pytest

from lodestone.llm import chat, decontaminate, html_text, licenses, mixing, sharding, simhash, tokens_out, topk, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1), (4, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "The CAT sat, on the mat!"), (2, None), (3, ""), (4, "moon"), (5, "gamma delta alpha"), (None, "looked at the moon")], "item_id long, text string")


RUNS = {
    "sharding": lambda d, b, y: sharding.op1_sharding(d),
    "simhash": lambda d, b, y: simhash.op3_simhash(d),
    "licenses": lambda d, b, y: licenses.op4_licenses(d),
    "toxicity": lambda d, b, y: toxicity.op5_toxicity(d, y),
    "tokens": lambda d, b, y: tokens_out.op6_token_output(d),
    "mixing": lambda d, b, y: mixing.op10_mixing(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_a_row_for_each_document(odd_docs, no_docs, bench, labels, name):
    assert RUNS[name](odd_docs, bench, labels).count() == 7
    assert RUNS[name](no_docs, bench, labels).count() == 0
    assert RUNS[name](odd_docs.limit(0), bench.limit(0), labels.limit(0)).count() == 0


def test_decontamination(odd_docs, no_docs, bench):
    got = sorted(tuple(r) for r in decontaminate.op8_decontaminate(odd_docs, bench).select("doc_id", "item_id", "containment").collect() if r.item_id is not None)
    assert got == [(1, 1, 1.0), (1, 4, 1.0), (4, 5, 1.0)]
    assert decontaminate.op8_decontaminate(no_docs, bench).count() == 0
    assert decontaminate.op8_decontaminate(odd_docs, bench.limit(0)).count() == 0


def test_filters_keep_columns(odd_docs, no_docs, bench, labels):
    for make in (lambda d: toxicity.without_toxic(d, labels), simhash.keep_one, lambda d: decontaminate.without_leaks(d, bench), mixing.mix_documents):
        assert make(odd_docs).columns == odd_docs.columns
        assert make(no_docs).count() == 0
    assert sorted(r.doc_id or 0 for r in decontaminate.without_leaks(odd_docs, bench).collect()) == [0, 2, 3, 5]
    assert sorted(r.doc_id for r in simhash.keep_one(odd_docs).collect()) == [1, 2, 4, 5]


def test_filters_decide_by_row(spark):
    words = [f"{a}{b}" for a in ("river", "stone", "light", "paper", "winter") for b in ("ing", "ed", "ful", "less", "ward", "ling")]
    first, second, third = (" ".join(words[at:] + words[:at][::-1] + [str(at) * 9] * 20) for at in (0, 11, 23))
    docs = spark.createDataFrame([(1, first), (1, second), (None, third), (None, third), (2, second), (None, first)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect()) == sorted([(1, first), (1, second), (0, third)])
    items = spark.createDataFrame([("i", third)], "item_id string, text string")
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.without_leaks(docs, items).collect()) == sorted([(1, first), (1, second), (2, second), (0, first)])


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, 0), (None, None, "", 0), (2, "u", "<article><p>A &amp; b<p>c</article>", 1), (3, "u", "<", 2), (4, "u", "<p" * 5000, 2)], "page_id long, url string, html string, n_chars int")
    got = html_text.op9_html(pages).collect()
    assert len(got) == 5 and {r.page_id: r.text for r in got}[2] == "A & b\nc"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.op9_html(pages.limit(0)).count() == 0


def test_conversations(spark):
    turns = spark.createDataFrame([(1, None, None, None, "x"), (1, 0, "user", "a", "y"), (1, 0, "user", "a", "y"), (None, 3, "bot", "", None)], "conv_id long, turn long, role string, text string, pos string")
    got = chat.op7_chat(turns).collect()
    assert len(got) == 4 + 2
    assert chat.op7_chat(turns.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(20, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (1, None, 2), (2, [None, 1.0], 2), (3, [float("inf"), 0.0], 3), (4, [], 1), (None, [1.0, 1.0], 1), (5, [0.5, 0.25], 1), (6, [0.0, 0.0], 1), (40, [1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in topk.op2_topk(vectors).collect())
    assert got == [(20, 1, 5, 32 * 64 + 16 * 128), (20, 2, 6, 0)]
    assert topk.op2_topk(vectors.limit(0)).count() == 0
