"""Places and running sums against plain loops."""

import random

import pytest

from lodestone.operators import scan


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    keys = ["hot"] * 400 + [None] * 40 + [f"k{n % 30}" for n in range(160)]
    return [(k, draw.choice([None, *range(90)]), n, draw.choice([None, 1, 2, 5])) for n, k in enumerate(keys)]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))


def test_places_and_sums(spark, rows):
    frame = spark.createDataFrame(rows, "k string, o long, n long, v long").repartition(7)
    got = {r.n: r.place for r in scan.places(frame, ["k"], ["o", "n"], parts=9).collect()}
    sums = {r.n: r.s for r in scan.running(frame, ["k"], ["o", "n"], {"s": "v"}, parts=9).collect()}
    seen, total = {}, {}
    for k, _, n, v in ordered(rows):
        assert got[n] == seen.get(k, 0)
        seen[k], total[k] = seen.get(k, 0) + 1, total.get(k, 0) + (v or 0)
        assert sums[n] == total[k]
    assert len(got) == len(rows) == len(sums)


def test_without_a_group(spark, rows):
    frame = spark.createDataFrame(rows, "k string, o long, n long, v long")
    by = [r[2] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))]
    got = {r.n: (r.at, r.before) for r in scan.places(frame, [], ["o", "n"], "at", parts=9).join(scan.previous(frame, ["o", "n"], ["n"], parts=9).selectExpr("n", "n_before AS before"), "n").collect()}
    assert [got[n] for n in by] == [(at, by[at - 1] if at else None) for at in range(len(by))]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, o long, v long")
    assert scan.places(empty, ["k"], ["o"]).count() == scan.running(empty, ["k"], ["o"], {"s": "v"}).count() == scan.previous(empty, ["o"], ["v"]).count() == 0


def test_equal_rows_have_places_of_their_own(spark):
    same = spark.range(500).selectExpr("'a' AS k", "1 AS o")
    assert sorted(r.place for r in scan.places(same, ["k"], ["o"], parts=4).collect()) == list(range(500))
