"""The manifest against a plain tree."""

import hashlib
import zlib

import pytest

from lodestone.llm import merkle


def joined_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([joined_hash(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, at):
    out = []
    for own in levels[:-1]:
        run, k = own[at // 16 * 16 : at // 16 * 16 + 16], at % 16
        out.append((run[:k], run[k + 1 :]))
        at //= 16
    return out


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((joined_hash(*map(field, r)), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = [levels_of([leaf for leaf, _ in sources[s]]) for s in order]
    top = levels_of([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for at, (leaf, r) in enumerate(sources[s]):
            path, found = siblings(trees[k], at) + siblings(top, k), leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                found = joined_hash(*map(field, (*r[:4], low)))
            for before, after in path:
                found = joined_hash(*before, found, *after)
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], joined_hash(*(d for a, b in path for d in a + b)), found, found == top[-1][0]))
    return sorted(out, key=repr)


def query(docs):
    return sorted((tuple(r) for r in merkle.op11_merkle(docs).collect()), key=repr)


def read(docs):
    return [tuple(r[c] for c in merkle.FIELDS) for r in docs.collect()]


def test_given_tables(spark, small, sql):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = query(docs)
    assert got == plain(read(docs)) and {r[-1] for r in got} == {True, False}
    assert got == sorted(sql.execute(merkle.oracle()).fetchall(), key=repr)


def test_odd_rows(odd_docs, no_docs):
    assert query(odd_docs) == plain(read(odd_docs))
    assert merkle.op11_merkle(no_docs).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert query(no_docs) == query(odd_docs.limit(0)) == []


@pytest.mark.parametrize("band", [1, 2])
def test_several_bands_and_sources_of_all_sizes(spark, monkeypatch, band):
    monkeypatch.setattr(merkle, "BAND", band)
    rows, n = [], 0
    for s, size in enumerate([1, 2, 15, 16, 17, 32, 33, 256, 257, 700]):
        for _ in range(size):
            rows.append((n, f"s{s}", "en", n, f"Text {n}"))
            n += 1
    rows += [(9999, "hot", "en", 1, "SAME")] * 300 + [(None, None, None, None, None)] * 18
    rows += [(20_000 + k, f"lone{k}", None, 0, "") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    assert query(docs) == plain(rows)


def test_one_document(spark):
    docs = spark.createDataFrame([(3, "s", None, None, "Aé")], "doc_id long, source string, lang string, n_chars long, text string")
    got = query(docs)
    assert got == plain(read(docs)) and got[0][1] == got[0][2] == got[0][3]


def test_children_in_any_order():
    leaves = [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(300)]
    want = levels_of([d.hex() for d in leaves])
    order = sorted(range(300), key=lambda k: hashlib.md5(str(k).encode()).digest())
    whole, made = merkle.Combiner(), []
    for part in (order[:80], order[80:200], order[200:]):
        own = merkle.Combiner()
        for k in part:
            made += own.arrive(7, 300, 0, k, leaves[k])
        made += whole.merge(own)
    assert not whole.partial
    assert {(level, at): digest.hex() for _, _, level, at, digest, _ in made} == {(level, at): d for level in (1, 2, 3) for at, d in enumerate(want[level])}
