"""Prefix trie of conversations, forked by groups of five.

Conversations are rebuilt from their group's first one, and every distinct sequence of first turns is a node. A turn is known
by the SHA-256 of its role and text, so texts are hashed where they lie and never shuffled. Conversations are dealt out by
their first turn's digest, many first turns to a group; a group builds pointer-dictionary tries of its conversations and sums
them up from the leaves by an iterative postorder.

A first turn whose conversations have more than SUBTRIE_TURNS turns is not given to one group: its conversations are dealt out
by their next turn instead, and so on until all subtries fit. Each round looks at twice as many turns as the one before, so a
conversation of n turns, or many copies of one, takes log n rounds. For that, every turn carries its prefix's key: the exclusive
or of 128 bits hashed from each turn's digest and place, summed over blocks of BLOCK turns first, so that no task holds a
conversation. Nodes above the subtries are aggregated by key. What lies below them is added along the paths of their members: a
conversation carries its subtrie's sums up its own path, once for each subtrie, and nodes add up what passes.

Scale: rows are digests; a group holds SUBTRIE_TURNS turns of a subtrie, and as many again of others on average. The one thing
done in sequence is the digest of the conversations that end at one node: their numbers are streamed in order through one task.

Defined results: turns are ordered by turn (null first), equal ones by digest; null role or text is empty; repeated turns are
turns of their own; rows with a null conv_id belong to no conversation; a negative conv_id belongs to the group of the next smaller
multiple of five; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lodestone.llm.common import crc32_sql, join_spread, maybe_broadcast, numbered, release, stored
from lodestone.operators.scan import places

FORK, MOST_SHARED = 5, 8  # conversations of a group; most turns that one takes over from the group's first
SUBTRIE_TURNS = 4096
BLOCK = 1024
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [f.split()[0] for f in NODE.split(", ")]
NONE = hashlib.sha256(b"").hexdigest()


# --- conversations ------------------------------------------------------------------------------------------


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its group's first one."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("long")


def turn_digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of turns (conv_id, turn, role, text): (conv_id, pos, turn, n_bytes, len) of all rebuilt turns, and (conv_id, len) of all
    conversations, also those without turns."""
    rows, ties = numbered(turns.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL"))
    slim = rows.select("conv_id", F.col("turn").alias("number"), F.unhex(turn_digest(F.col("role"), F.col("text"))).alias("turn"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), *ties)
    own = stored(places(stored(slim, "trie-turns"), ["conv_id"], ["number", "turn", *ties], "pos").select("conv_id", "pos", "turn", "n_bytes"), "trie-places")
    counted = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": shared_turns(F.col("conv_id")), "first": F.col("conv_id") - F.expr(f"pmod(conv_id, {FORK})")})
    counted = stored(counted, "trie-counts")
    sizes = counted.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    shared = F.least("h", F.coalesce("n_first", F.lit(0)))
    convs = counted.join(sizes, "first", "left").withColumn("shared", shared)
    convs = stored(convs.select("conv_id", "first", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-conversations")
    taken = convs.select("conv_id", "first", "shared", "len").where("shared > 0")
    heads = own.where(F.col("pos") < MOST_SHARED).withColumnRenamed("conv_id", "first")  # a few rows for each conversation
    heads = heads.join(taken, "first").where("pos < shared").select("conv_id", "pos", "turn", "n_bytes", "len")
    tails = own.where(F.col("pos") >= shared_turns(F.col("conv_id")))
    n = own.count()
    tails = join_spread(tails, convs.select("conv_id", "h", "shared", "len"), "conv_id", n).select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "turn", "n_bytes", "len")
    whole = stored(heads.unionByName(tails), "trie-rebuilt")
    release(own, counted)
    return whole, convs.select("conv_id", "len")


def with_keys(rows: DataFrame) -> DataFrame:
    """rows (conv_id, pos, turn, ...) with depth (pos + 1), the key a, b of the turns up to this one, and the key up_a, up_b of
    those before it. Keys are 0 for no turns."""
    rows = rows.withColumns({"depth": F.col("pos") + 1, "x": F.xxhash64("turn", "pos"), "y": F.xxhash64(F.lit("second"), "pos", "turn"), "block": F.floor(F.col("pos") / BLOCK)})
    inside = W.Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    keyed = rows.withColumns({"a": F.bit_xor("x").over(inside), "b": F.bit_xor("y").over(inside)})
    if not rows.where(F.col("len") > BLOCK).isEmpty():
        before = W.Window.partitionBy("conv_id").orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each block
        blocks = rows.where(F.col("len") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        bases = blocks.select("conv_id", "block", F.bit_xor("x").over(before).alias("base_a"), F.bit_xor("y").over(before).alias("base_b")).where("block > 0")
        keyed = keyed.join(bases, ["conv_id", "block"], "left")
        keyed = keyed.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"base_{c}", F.lit(0).cast("long"))) for c in "ab"})
    return keyed.select("conv_id", "depth", "turn", "n_bytes", "len", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"))


# --- dealing out --------------------------------------------------------------------------------------------

_KEY = ["depth", "a", "b"]


def dealt_out(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(conv_id, top): the depth from which each conversation lies in a subtrie of at most `limit` turns; conversations without one
    are missing. And the nodes above: (depth, a, b, up_a, up_b, conv_id, n_convs, n_bytes), None if there are none."""
    homes, uppers, low, width, active = [], [], 1, 1, None
    while True:
        band = rows.where((F.col("depth") >= low) & (F.col("depth") < low + width))
        if active is not None:
            band = band.join(active, "conv_id", "left_semi")
        nodes = band.groupBy(*_KEY).agg(F.sum(F.col("len") - F.col("depth") + 1).alias("turns"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"))
        over = stored(nodes.where(F.col("turns") > limit).drop("turns"), "trie-over")
        n_over = over.count()
        if not n_over:
            homes.append(band.groupBy("conv_id").agg(F.min("depth").alias("top")))
            break
        uppers.append(over)
        marked = band.join(maybe_broadcast(over.select(*_KEY, F.lit(True).alias("over")), n_over, 48), _KEY, "left")
        found = stored(marked.groupBy("conv_id").agg(F.min(F.when(F.col("over").isNull(), F.col("depth"))).alias("top"), F.max("len").alias("len")), "trie-homes")
        homes.append(found.where("top IS NOT NULL").select("conv_id", "top"))
        low, width = low + width, 2 * width
        active = found.where(F.col("top").isNull() & (F.col("len") >= low)).select("conv_id")
    home = homes[0]
    for h in homes[1:]:
        home = home.unionByName(h)
    upper = None
    for u in uppers:
        upper = u if upper is None else upper.unionByName(u)
    return home, upper


# --- tries --------------------------------------------------------------------------------------------------

#: A trie's node; `up_a` and `up_b` name the node above a top.
_SUBTRIE = NODE + ", is_top boolean, up_a long, up_b long"


class Trie:
    """Nodes by number, each with a dictionary of pointers to its children; conversations arrive by rising number."""

    def __init__(self) -> None:
        self.tops: dict = {}
        self.children: list[dict] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.first: list[int] = []
        self.n_convs: list[int] = []
        self.n_bytes: list[int] = []
        self.ends: list[list[int]] = []

    def step(self, at: int | None, key: object, conv: int, depth: int, n_bytes: int) -> int:
        """The node that a conversation reaches by a turn from node `at`, or from above."""
        pointers = self.tops if at is None else self.children[at]
        node = pointers.get(key)
        if node is None:
            node = pointers[key] = len(self.parent)
            self.children.append({})
            self.parent.append(-1 if at is None else at)
            self.depth.append(depth)
            self.first.append(conv)
            self.n_convs.append(0)
            self.n_bytes.append(n_bytes)
            self.ends.append([])
        self.n_convs[node] += 1
        return node

    def postorder(self) -> Iterator[int]:
        """Children before their parents."""
        for top in self.tops.values():
            stack, out = [top], []
            while stack:
                node = stack.pop()
                out.append(node)
                stack.extend(self.children[node].values())
            yield from reversed(out)

    def sums(self) -> tuple[list[int], list[int]]:
        """Leaves and saved tokens of every node's subtree."""
        leaves, saved = [0] * len(self.parent), [0] * len(self.parent)
        for node in self.postorder():
            leaves[node] += not self.children[node]
            saved[node] += (self.n_convs[node] - 1) * self.n_bytes[node]
            if (up := self.parent[node]) >= 0:
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        return leaves, saved


def ends_digest(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest() if convs else NONE


def _subtries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tries of a group's conversations, from their tops."""
    trie, above = Trie(), {}
    last, at = None, None
    pdf = pdf.sort_values(["conv_id", "depth"])
    for conv, depth, top, turn, n_bytes, length, a, b, up_a, up_b in zip(*(pdf[c].tolist() for c in ("conv_id", "depth", "top", "turn", "n_bytes", "len", "a", "b", "up_a", "up_b")), strict=True):
        if depth == top:
            at = trie.step(None, (depth, a, b), conv, depth, n_bytes)
            above[at] = (up_a, up_b)
        else:
            assert conv == last, "a conversation begins at its top"
            at = trie.step(at, turn, conv, depth, n_bytes)
        if depth == length:
            trie.ends[at].append(conv)
        last = conv
    leaves, saved = trie.sums()
    up = [above.get(k, (0, 0)) for k in range(len(leaves))]
    return pd.DataFrame(
        {
            "conv_id": trie.first, "depth": trie.depth, "parent_conv_id": pd.array([trie.first[p] if p >= 0 else None for p in trie.parent], "Int64"), "n_convs": trie.n_convs, "n_children": list(map(len, trie.children)),
            "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": list(map(ends_digest, trie.ends)), "is_top": [p < 0 for p in trie.parent], "up_a": [u[0] for u in up], "up_b": [u[1] for u in up],
        }
    )


def subtries(rows: DataFrame, homes: DataFrame, n_rows: int, limit: int) -> DataFrame:
    """The nodes from each conversation's top on. Tops are hashed into groups of about `limit` turns."""
    first = homes.join(rows.select("conv_id", F.col("depth").alias("top"), "a", "b"), ["conv_id", "top"])
    n_groups = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // limit + 1)
    dealt = first.select("conv_id", "top", F.expr(f"pmod(xxhash64(top, a, b), {n_groups})").alias("group"))
    own = join_spread(rows, stored(dealt, "trie-groups"), "conv_id", n_rows).where("depth >= top")
    return own.groupBy("group").applyInPandas(_subtries, _SUBTRIE)


# --- above the subtries -------------------------------------------------------------------------------------


def streamed_ends(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of ends (depth, a, b, conv_id): numbers are hashed as they arrive, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            for *own, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if len(done) >= 10_000:
                yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=[*_KEY, "ends_sha256"])
                done = []
        if key is not None:
            done.append((*key, digest.hexdigest()))
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names=[*_KEY, "ends_sha256"])

    dealt = ends.select(*_KEY, "conv_id").repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id")
    return dealt.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _above(rows: DataFrame, upper: DataFrame, tops: DataFrame, least: int) -> DataFrame:
    """The nodes over the subtries but the root, from their tops (depth, up_a, up_b, conv_id, n_leaves, saved_tokens)."""
    down = lambda df: df.select((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    children = down(tops).unionByName(down(upper)).groupBy(*_KEY).agg(F.count("*").alias("n_children"))
    nodes = stored(upper.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-above")
    # What each conversation carries up its path, from the deepest node above its subtrie; a node's own part from the node.
    given = tops.select("conv_id", (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens").where("depth > 0")
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    given = given.unionByName(own).groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    n = nodes.count()
    path = rows.select("conv_id", "depth", "len", "a", "b").join(maybe_broadcast(nodes.select(*_KEY), n, 48), _KEY, "left_semi")
    path = stored(path, "trie-paths")
    carried = path.join(given.select("conv_id").distinct(), "conv_id", "left_semi").join(given, ["conv_id", "depth"], "left")
    below = W.Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    sums = {c: F.sum(F.coalesce(c, F.lit(0))).over(below) for c in ("n_leaves", "saved_tokens")}
    sums = carried.withColumns(sums).groupBy(*_KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = streamed_ends(path.where("depth = len"))
    parents = nodes.select(F.col("depth").alias("pd"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("pc"))
    out = nodes.join(sums, _KEY).join(ends, _KEY, "left").withColumn("pd", F.col("depth") - 1).join(parents, ["pd", "up_a", "up_b"], "left")
    out = out.withColumns({"parent_conv_id": F.coalesce("pc", F.lit(least)), "ends_sha256": F.coalesce("ends_sha256", F.lit(NONE))})
    return out.select(*COLUMNS, "a", "b")


def trie(turns: DataFrame, limit: int = SUBTRIE_TURNS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, as NODE."""
    spark = turns.sparkSession
    bare, convs = rebuilt(turns)
    n_convs, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    if not n_convs:
        return spark.createDataFrame([], NODE)
    rows = stored(with_keys(bare), "trie-keys")
    release(bare)
    homes, upper = dealt_out(rows, limit)
    low = stored(subtries(rows, homes, rows.count(), limit), "trie-nodes")
    tops = low.where("is_top")
    inner = low.where("NOT is_top").select(*COLUMNS)
    if upper is None:
        found = inner.unionByName(tops.withColumn("parent_conv_id", F.lit(least).cast("long")).select(*COLUMNS))
    else:
        above = stored(_above(rows, stored(upper, "trie-upper"), tops, least), "trie-above")
        up = above.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("up"))
        hung = tops.join(up, ["depth", "up_a", "up_b"], "left").withColumn("parent_conv_id", F.coalesce("up", F.lit(least)))
        found = inner.unionByName(hung.select(*COLUMNS)).unionByName(above.select(*COLUMNS))
    first = found.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    zero = [F.lit(0).cast("long").alias(c) for c in _KEY]
    ends = streamed_ends(convs.where("len = 0").select(*zero, "conv_id")).agg(F.coalesce(F.max("ends_sha256"), F.lit(NONE)).alias("ends_sha256"))  # at most one row
    root = first.join(F.broadcast(ends), F.lit(True)).select(F.lit(least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return found.unionByName(root)


def op13_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node."""
    return trie(turns)


ORACLE_SQL = f"""
WITH placed AS (
  SELECT conv_id, strlen(coalesce(text, '')) AS n_bytes, turn_, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_) - 1 AS pos
  FROM (SELECT *, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_ FROM conversations WHERE conv_id IS NOT NULL)
), counted AS (
  SELECT conv_id, count(*) AS n, {crc32_sql("any_value(conv_id)::VARCHAR")} % {MOST_SHARED + 1} AS h, conv_id - (conv_id % {FORK} + {FORK}) % {FORK} AS first FROM placed GROUP BY conv_id
), convs AS (
  SELECT c.conv_id, c.first, c.h, least(c.h, coalesce(f.n, 0)) AS shared, least(c.h, coalesce(f.n, 0)) + greatest(c.n - c.h, 0) AS len
  FROM counted c LEFT JOIN counted f ON c.first = f.conv_id
), rebuilt AS (
  SELECT c.conv_id, p.pos + 1 AS depth, p.turn_, p.n_bytes, c.len FROM convs c JOIN placed p ON p.conv_id = c.first AND p.pos < c.shared
  UNION ALL SELECT c.conv_id, p.pos - c.h + c.shared + 1, p.turn_, p.n_bytes, c.len FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos >= c.h
), paths AS (
  SELECT conv_id, depth, n_bytes, len, sha256(string_agg(turn_, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, len, '' FROM convs
), linked AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM paths
), nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(up) AS up, (count(*) - 1) * max(n_bytes) AS saved,
         sha256(coalesce(string_agg(CASE WHEN len = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM linked GROUP BY depth, key
), children AS (
  SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), whole AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, key)
), sums AS (
  SELECT l.depth, l.key, CAST(sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(w.saved) AS BIGINT) AS saved_tokens
  FROM linked l JOIN whole w ON l.conv_id = w.conv_id AND l.depth <= w.depth GROUP BY ALL
)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM whole w JOIN sums s USING (depth, key) LEFT JOIN nodes p ON p.depth = w.depth - 1 AND p.key = w.up
"""
