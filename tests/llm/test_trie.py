"""The trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from lodestone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    made = {c: tuple(own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :]) for c in own}
    nodes = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            nodes.setdefault(made[c][:d], []).append(c)
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] += not children[path]
        if path:
            saved[path] += (len(nodes[path]) - 1) * len(path[-1][1].encode())
            children[path[:-1]] += 1
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    out = []
    for path, convs in nodes.items():
        ends = ",".join(str(c) for c in convs if made[c] == path)
        out.append((convs[0], len(path), nodes[path[:-1]][0] if path else None, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, limit=trie.SUBTRIE_TURNS):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in trie.trie(frame, limit).collect()), key=repr)


def test_given_tables(spark, small, sql):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    got = sorted((tuple(r) for r in trie.op13_trie(turns).collect()), key=repr)
    assert got == plain([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert got == sorted(sql.execute(trie.ORACLE_SQL).fetchall(), key=repr)


def branching(seed):
    draw = random.Random(seed)
    rows = []
    for c in range(120):
        for t in range(draw.choice([1, 2, 3, 9, 14])):
            rows.append((c * draw.choice([1, 1, 1, 5]), t, draw.choice(["user", "assistant"]), draw.choice(["é", "same", f"own {draw.randrange(4)}"]) if t else draw.choice(["hot", "hot", "cold"])))
    return rows


@pytest.mark.parametrize("limit", [1, 7, 60, 10_000])
def test_oversized_subtries(spark, limit):
    rows = branching(limit)
    assert found(spark, rows, limit) == plain(rows)


def test_long_copies(spark, monkeypatch):
    """A conversation that holds most turns, and a copy of it, beyond the size of subtries and of blocks."""
    monkeypatch.setattr(trie, "BLOCK", 16)
    long = [(c, t, "user", f"turn {t}") for c in (5, 10) for t in range(150)]
    rows = [*long, *((15, t, "user", f"turn {t}" if t != 70 else "other") for t in range(150)), *((c, 0, "user", "turn 0") for c in range(100, 160, 5))]
    assert found(spark, rows, 20) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (None, 3, "bot", ""), (-3, 1, "x", "y"), (-5, 0, "", ""), (7, 1, "a", "x" * 200_000), (0, 0, "1:u", "a"), (5, 0, "1", ":ua")]
    assert found(spark, rows) == plain(rows)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", pos string, depth int")
    assert sorted((tuple(r) for r in trie.op13_trie(frame).collect()), key=repr) == plain(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.op13_trie(empty).columns == trie.COLUMNS and trie.op13_trie(empty).count() == 0


def test_conversations_without_turns(spark):
    """Where the group's first conversation is missing and all own turns are taken over, nothing is left."""
    bare = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:30]
    rows = [(c, 0, "user", "a") for c in bare]
    assert found(spark, rows) == plain(rows)
