"""Quality measures against plain counts, verdicts against the table."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def texts():
    draw = random.Random(3)
    out = [None, "", " \t\n\x0b\f\r", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a b a a a", "x\n\nx\n x\nx", " lead\r\ntrail ", "é # | <>  $%&*", "漢字 漢字 漢字 漢字", "\x1c a\x1cb \x85"]
    for size in (5, 12, 40, 300, 3000):
        for letters in (2, 5, 40):
            out.append("".join(f"w{draw.randrange(letters)}{draw.choice([' ', ' ', '  ', chr(10)])}" for _ in range(size)))
    return [*out, "Word " * 60_000, " ".join(f"w{k}" for k in range(50_000)) + " w1 w2 w3 w4"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(8)


def test_counts(table):
    got = {r.doc_id: tuple(r)[1:6] for r in quality.op12_quality(table).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts())}


def test_hashes_that_collide(spark):
    """With hashes of few values, windows are told apart by their words."""
    some = [t for t in texts() if t is not None and len(t) < 5000]
    frame = spark.createDataFrame(list(enumerate(some)), "id long, text string")
    for hashed in (lambda *c: F.lit(1 << 40).cast("long"), lambda *c: F.shiftleft(F.xxhash64(*c).bitwiseAND(F.lit(3)), 40)):
        got = frame.select("id", quality.repeated_words(quality.words_of(F.col("text")), hashed).alias("n")).collect()
        assert {r.id: r.n for r in got} == {k: plain(t)[4] for k, t in enumerate(some)}


def test_given_tables(spark, small, sql):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = quality.op12_quality(docs).collect()
    assert sorted(map(tuple, got)) == sorted(sql.execute(quality.oracle()).fetchall())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    for r in got:
        if r.doc_id in labels:
            assert r.kept == (labels[r.doc_id] == 1 and not r.base_failed), r


def test_odd_rows(odd_docs, no_docs):
    assert odd_docs.count() == quality.op12_quality(odd_docs).count() == 7
    assert quality.op12_quality(no_docs).count() == 0
    assert {r.kept for r in quality.op12_quality(odd_docs.where("text IS NULL OR trim(text) = ''")).collect()} == {False}
    clash = odd_docs.withColumns({"measures": F.lit(1), "failed": F.lit("x")})
    assert quality.without_poor(clash).columns == clash.columns
    rows, own, failed = quality.verdicts(clash, F.col("text"))
    assert set(clash.columns) < set(rows.columns) and own not in clash.columns and failed not in clash.columns


def test_rules(spark):
    good = " ".join(f"the river{k} and stone{k} were of light{k}" for k in range(20))
    cases = {
        good: "",
        "the and of": "words",
        good.upper(): "stop_words,capitals",
        good.replace(" ", "### "): "symbols,stop_words",
        "\n".join(f"- {x} of the" for x in good.split()): "bullet_lines",
        "\n".join(f"{x} of the..." for x in good.split()): "ellipsis_lines",
        good + "\nsame line here" * 4 + "\n" + "\n".join(good.split()[:1]): "duplicate_lines",
        good.replace("river", "r" * 90): "word_length",
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.failed for r in quality.op12_quality(rows).collect()}
    for k, want in enumerate(cases.values()):
        assert set(filter(None, want.split(","))) <= set(got[k].split(",")) and (want or not got[k]), (k, got[k])
    few = (quality.Rule("words", "n_words", most=10, from_words=5),)
    assert [r.doc_id for r in quality.without_poor(rows, few).collect()] == [1]
    with pytest.raises(ValueError, match="unknown"):
        quality.without_poor(rows, (quality.Rule("x", "nothing", least=1),))


def test_no_python_in_the_plan(table):
    plan = quality.op12_quality(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("Exchange RoundRobinPartitioning", "")
