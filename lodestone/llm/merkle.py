"""Merkle manifest of a dataset: a tree of arity 16 for each source, and one over the sources' roots.

Leaves are digests of whole rows, computed by Spark's own functions; only digests leave the scan. Their places within their
source come from ranges of (source, doc_id, leaf), so a source of any size is dealt to all tasks. The tree is built by
combining: every arriving child is put, under its place, into the partial parent that its place belongs to; the parent's arity
follows from the number of nodes of its level, and when it is met, the parent's digest is emitted and arrives at its own parent,
up to the root. First each task combines the leaves of its range, so nearly all parents are complete before anything is
shuffled. What is left, the children of partial parents, is the frontier: it is shuffled by its ancestor BAND levels
further up and combined again, until only roots are left. A task holds the partial parents along one path, since rows arrive
in order of the leaves that they cover.

A complete parent is written with its children (the reverse links). Proofs run down these links, band by band: a block (the
nodes below one ancestor of the band's top) receives the ancestor's proof and gives those of its lowest nodes, which are handed
to the blocks below; the last band proves leaves. Only one proof for each 16^BAND leaves is stored, beside what is returned.

Scale: rows are shuffled as digests, once into ranges and once into blocks of 16^BAND leaves. There are as many rounds as a tree has
bands: three for 10^10 rows. The tree over sources is built and proved by the same code, so there may be many. The driver sees
the number of sources, the largest tree's size and the root.

Defined results: nulls in any column are `-` in the leaf; a null source is a source of its own, the first; rows with equal doc_id
are ordered by leaf, null doc_id first; equal rows are leaves of their own, each with its proof; a null doc_id is not tampered with;
an empty table has no rows and no root; columns other than the five take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, ascii_lower, crc32_sql, join_spread, numbered, release, stored
from lodestone.operators.scan import places

ARITY_BITS = 4
ARITY = 1 << ARITY_BITS
BAND = 3  # levels that one round combines or proves: 4096 leaves of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BATCH = 10_000

NODES = "tree long, n long, level int, at long, digest binary, children binary"
PATHS = "tree long, n long, level int, at long, path binary, top long, subroot binary"
PROVED = "doc_id long, leaf binary, subroot binary, proof binary, folded binary"


def node_digest(children: bytes) -> bytes:
    """The digest of a node from its children's 32 bytes each, in order: SHA-256 of their lower-case hexadecimal text."""
    return hashlib.sha256(children.hex().encode()).digest()


def n_nodes(n: int, level: int) -> int:
    """Nodes on a level of a tree of n leaves."""
    return -(-n >> (ARITY_BITS * level)) if level else n


def height(n: int) -> int:
    """The root's level in a tree of n leaves: 0 for a lone leaf, which is the root itself."""
    level = 0
    while n_nodes(n, level) > 1:
        level += 1
    return level


# --- leaves -------------------------------------------------------------------------------------------------


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, in hexadecimal: each `-` if null, else its length in bytes, a colon and its text."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def tampered(doc_id: Column) -> Column:
    """Whether a row is one of those whose text the query alters."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --- combining ----------------------------------------------------------------------------------------------


class Combiner:
    """Partial parents, each with the children that have arrived under their places."""

    def __init__(self) -> None:
        self.partial: dict[tuple[int, int, int], tuple[int, dict[int, bytes]]] = {}

    def arrive(self, tree: int, n: int, level: int, at: int, digest: bytes) -> Iterator[tuple]:
        """Hands a node to its parent; gives each ancestor that this completes, with its children."""
        while n_nodes(n, level) > 1:
            key = (tree, level + 1, at >> ARITY_BITS)
            _, children = self.partial.setdefault(key, (n, {}))
            children[at % ARITY] = digest
            level, at = level + 1, at >> ARITY_BITS
            if len(children) < min(ARITY, n_nodes(n, level - 1) - at * ARITY):
                return
            del self.partial[key]
            joined = b"".join(children[k] for k in range(len(children)))
            digest = node_digest(joined)
            yield tree, n, level, at, digest, joined

    def merge(self, other: Combiner) -> Iterator[tuple]:
        """Takes over another combiner's partial parents; gives what this completes."""
        for tree, n, level, at, digest in other.frontier():
            yield from self.arrive(tree, n, level, at, digest)

    def frontier(self) -> Iterator[tuple]:
        """The children of all parents that are not complete."""
        for (tree, level, at), (n, children) in self.partial.items():
            for k, digest in children.items():
                yield tree, n, level - 1, at * ARITY + k, digest


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _combine(nodes: DataFrame) -> DataFrame:
    """One round over nodes (tree, n, level, at, digest): complete parents with their children, and the frontier without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = Combiner()

        def made() -> Iterator[tuple]:
            for r in _rows(batches):
                yield from combiner.arrive(*r)
            for r in combiner.frontier():
                yield *r, None

        yield from _batches(made(), _arrow(NODES))

    return nodes.select("tree", "n", "level", "at", "digest").mapInArrow(run, NODES)


def _shifted(at: str, by: Column) -> Column:
    """The place of the ancestor `by` levels up."""
    return F.call_function("shiftright", F.col(at), by * ARITY_BITS)


def _block(band: int) -> Column:
    """The ancestor on the band's highest level; nodes that lie above wait under their own place."""
    return _shifted("at", F.greatest(F.lit((band + 1) * BAND) - F.col("level"), F.lit(0)))


def build(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Of leaves (tree, n, at, digest): all parents, as NODES, and the largest tree's number of leaves."""
    first = leaves.withColumn("level", F.lit(0))
    made = stored(_combine(first), "merkle-nodes")
    parts, band, most = [made], 0, leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while (band == 0 or band * BAND < height(most)) and not (open_ := made.where("children IS NULL")).isEmpty():
        # Ordered by the leaves that they cover, children of one parent arrive together.
        ahead = open_.withColumns({"block": _block(band), "_from": F.call_function("shiftleft", F.col("at"), F.col("level") * ARITY_BITS)})
        made = stored(_combine(ahead.repartition("tree", "block").sortWithinPartitions("tree", "_from")), "merkle-nodes")
        parts.append(made)
        band += 1
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    out = stored(whole.where("children IS NOT NULL"), "merkle-parents")
    release(*parts)
    return out, most


# --- proofs -------------------------------------------------------------------------------------------------


def fold(digest: bytes, n: int, at: int, path: bytes) -> tuple[bytes, int]:
    """The root over a leaf, by the siblings on its path, and how many bytes of the path that took."""
    used, level = 0, 0
    while (width := n_nodes(n, level)) > 1:
        own = at % ARITY
        size = 32 * (min(ARITY, width - (at - own)) - 1)
        others = path[used : used + size]
        digest = node_digest(others[: 32 * own] + digest + others[32 * own :])
        used, level, at = used + size, level + 1, at >> ARITY_BITS
    return digest, used


class _Block:
    """Proofs on their way down: paths of nodes by (level, place), of the block that is being read."""

    def __init__(self) -> None:
        self.key, self.paths, self.runs = None, {}, {}

    def turn(self, key: tuple) -> None:
        if key != self.key:
            self.key, self.paths, self.runs = key, {}, {}

    def start(self, level: int, at: int, own: tuple) -> None:
        self.paths[level, at] = own

    def down(self, level: int, at: int, children: bytes) -> None:
        """A parent's children and its own path: its children's paths are both, but for the child itself."""
        self.runs[level, at] = (children, self.path(level, at))

    def _path(self, level: int, at: int) -> tuple:
        children, (path, *rest) = self.runs[level + 1, at >> ARITY_BITS]
        k = 32 * (at % ARITY)
        return (children[:k] + children[k + 32 :] + path, *rest)

    def path(self, level: int, at: int) -> tuple:
        return self.paths[level, at] if (level, at) in self.paths else self._path(level, at)


_READ = ["tree", "n", "level", "at", "kind", "digest", "other", "top", "doc_id"]


def _descend(rows: DataFrame, low: int, schema: str, give: Callable) -> DataFrame:
    """Reads blocks from their top: paths (kind 2), then parents (1) by falling level, then leaves (0). `give` takes a row that
    lies on the band's lowest level, and its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            block = _Block()
            for tree, n, level, at, kind, digest, other, top, doc_id, own_block in _rows(batches):
                block.turn((tree, own_block))
                if kind == 2:
                    block.start(level, at, (digest, top, other))
                elif kind == 1:
                    block.down(level, at, other)
                    if low and level - 1 == low:
                        for k in range(at * ARITY, at * ARITY + len(other) // 32):
                            yield tree, n, low, k, *block.path(low, k)
                else:
                    yield give(n, at, digest, other, doc_id, block.path(0, at))

        yield from _batches(made(), _arrow(schema))

    return rows.select(*_READ, "block").mapInArrow(run, schema)


def prove(leaves: DataFrame, parents: DataFrame, starts: DataFrame, most: int, schema: str, give: Callable) -> DataFrame:
    """leaves (tree, n, at, digest, other, doc_id) proved by `give(n, at, digest, other, doc_id, (path, top, subroot))`; starts: PATHS of
    the trees' roots."""
    none = lambda kind: F.lit(None).cast(kind)
    bands = max(1, -(-height(most) // BAND))
    paths = starts
    for band in reversed(range(bands)):
        low, high = band * BAND, (band + 1) * BAND
        here = paths.where((F.col("level") <= high) & ((F.col("level") > low) | (F.lit(band == 0))))
        kinds = [
            here.select("tree", "n", "level", "at", F.lit(2).alias("kind"), F.col("path").alias("digest"), F.col("subroot").alias("other"), "top", none("long").alias("doc_id")),
            parents.where(f"level > {low} AND level <= {high}").select("tree", "n", "level", "at", F.lit(1).alias("kind"), "digest", F.col("children").alias("other"), none("long").alias("top"), none("long").alias("doc_id")),
        ]
        if band == 0:
            kinds.append(leaves.select("tree", "n", F.lit(0).alias("level"), "at", F.lit(0).alias("kind"), "digest", "other", none("long").alias("top"), "doc_id"))
        whole = kinds[0]
        for k in kinds[1:]:
            whole = whole.unionByName(k)
        order = (2 * F.col("level") + F.when(F.col("kind") == 2, 1).otherwise(0)).alias("_o")
        whole = whole.select("*", _block(band).alias("block"), order).repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("_o"), "at")
        if band == 0:
            return _descend(whole, 0, schema, give)
        below = stored(_descend(whole, low, PATHS, give), "merkle-paths")
        # Roots that lie lower than this band start in a band of their own.
        paths = below.unionByName(starts.where(F.col("level") <= low))
    raise AssertionError


# --- manifest -----------------------------------------------------------------------------------------------


def _key(source: Column) -> Column:
    return F.concat(F.when(source.isNull(), "-").otherwise("+"), F.coalesce(source, F.lit("")))


def manifest(leaves: DataFrame, ties: list[str]) -> tuple[DataFrame, bytes | None]:
    """(doc_id, leaf, subroot, proof, folded) of leaves (source, doc_id, leaf, other, ties), digests as bytes, and the root. `proof`
    holds the siblings on the way to the root, 32 bytes each; `folded` is the root that they give with `other`, or with the leaf
    where that is null. `ties` are columns that tell equal rows apart."""
    at = stored(places(leaves, ["source"], ["doc_id", "leaf", *ties], "at"), "merkle-leaves")
    sources = at.groupBy("source").agg(F.count("*").alias("n"))
    sources = stored(places(sources, [], ["source"], "tree").select(_key(F.col("source")).alias("key"), "tree", "n"), "merkle-sources")
    n_trees, n_rows = sources.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_trees:
        release(at)
        return leaves.sparkSession.createDataFrame([], PROVED), None
    keyed = at.withColumn("key", _key(F.col("source")))
    sized = keyed.join(F.broadcast(sources), "key") if n_trees * 128 <= BROADCAST_BYTES else join_spread(keyed, sources, "key", n_rows)
    placed = stored(sized.select("tree", "n", "at", F.col("leaf").alias("digest"), "other", "doc_id"), "merkle-placed")
    release(at)
    parents, most = build(placed.sortWithinPartitions("tree", "at"))

    is_root = F.expr("at = 0 AND shiftright(n - 1, level * 4) = 0")
    roots = parents.where(is_root).select("tree", "n", "level", "digest").unionByName(placed.where("n = 1").select("tree", "n", F.lit(0).alias("level"), "digest"))
    roots = stored(roots, "merkle-roots")
    # The roots are the leaves of one more tree, in order of their sources.
    tops = roots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("at"), "digest")
    above, _ = build(tops.repartitionByRange("at").sortWithinPartitions("at"))
    root = bytes((above.where(is_root) if n_trees > 1 else tops).first().digest)
    start = leaves.sparkSession.createDataFrame([(0, n_trees, height(n_trees), 0, b"", 0, b"")], PATHS)
    own = tops.select("*", F.lit(None).cast("binary").alias("other"), F.lit(None).cast("long").alias("doc_id"))
    hung = prove(own, above, start, n_trees, "tree long, path binary, subroot binary", lambda n, at, digest, other, doc_id, path: (at, path[0], digest))
    starts = stored(hung.join(roots.select("tree", "n", "level"), "tree"), "merkle-starts")
    starts = starts.select("tree", "n", "level", F.lit(0).cast("long").alias("at"), "path", F.col("tree").alias("top"), "subroot")

    def give(n: int, at: int, digest: bytes, other: bytes | None, doc_id: int, path: tuple) -> tuple:
        proof, top, subroot = path
        sub, used = fold(digest if other is None else other, n, at, proof)
        return doc_id, digest, subroot, proof, fold(sub, n_trees, top, proof[used:])[0]

    return prove(placed, parents, starts, most, PROVED, give), root


def op11_merkle(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every document."""
    rows, ties = numbered(docs.select(*FIELDS))
    whole = [F.col(c) for c in FIELDS]
    forged = F.when(tampered(F.col("doc_id")), F.unhex(leaf(*whole[:-1], ascii_lower(F.col("text")))))
    leaves = stored(rows.select("doc_id", "source", F.unhex(leaf(*whole)).alias("leaf"), forged.alias("other"), *ties), "merkle-digests")
    proved, root = manifest(leaves, ties)
    text = lambda c: F.lower(F.hex(c))
    shown = F.lit(root.hex() if root else None).cast("string")
    proof = F.sha2(text("proof").cast("binary"), 256)
    return proved.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), shown.alias("root"), proof.alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == shown).alias("verified"))


ORACLE_SQL = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, {leaf} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {forged} END AS forged
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         row_number() OVER (ORDER BY doc_id, source, leaf) AS row_ FROM rows_
), names AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM rows_ GROUP BY source
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest FROM leaves l JOIN names n ON l.source IS NOT DISTINCT FROM n.source
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS width FROM nodes) WHERE width > 1 GROUP BY tree, level, pos // 16
), subs AS (
  SELECT tree, arg_max(digest, level) AS subroot, max(level) AS height FROM nodes GROUP BY tree
), tops AS (
  SELECT 0 AS level, tree AS pos, subroot AS digest FROM subs
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS width FROM tops) WHERE width > 1 GROUP BY level, pos // 16
), roots AS (
  SELECT arg_max(digest, level) AS root, max(level) AS height FROM tops
), runs AS (
  SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS own FROM nodes GROUP BY ALL
  UNION ALL SELECT NULL, level, pos // 16, list(digest ORDER BY pos) FROM tops GROUP BY ALL
), placed AS (
  SELECT row_, doc_id, leaf, forged, pos, tree, subroot, height, root, root_height
  FROM leaves l JOIN names n ON l.source IS NOT DISTINCT FROM n.source JOIN subs USING (tree), (SELECT root, height AS root_height FROM roots)
), steps AS (
  SELECT row_, level AS step, own[:k] AS before, own[k + 2:] AS after
  FROM (SELECT p.row_, r.level, r.own, CAST((p.pos >> (4 * r.level)) % 16 AS BIGINT) AS k
        FROM placed p JOIN runs r ON r.tree = p.tree AND r.run = p.pos >> (4 * r.level + 4) WHERE r.level < p.height)
  UNION ALL
  SELECT row_, 100 + level, own[:k], own[k + 2:]
  FROM (SELECT p.row_, r.level, r.own, CAST((p.tree >> (4 * r.level)) % 16 AS BIGINT) AS k
        FROM placed p JOIN runs r ON r.tree IS NULL AND r.run = p.tree >> (4 * r.level + 4) WHERE r.level < p.root_height)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY row_ ORDER BY step) AS turn FROM steps
), folds AS (
  SELECT row_, 0 AS turn, coalesce(forged, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.row_, o.turn, sha256(array_to_string(o.before, '') || f.digest || array_to_string(o.after, ''))
  FROM folds f JOIN ordered o ON o.row_ = f.row_ AND o.turn = f.turn + 1
), folded AS (
  SELECT row_, arg_max(digest, turn) AS folded_root FROM folds GROUP BY row_
), proofs AS (
  SELECT row_, string_agg(array_to_string(before, '') || array_to_string(after, ''), '' ORDER BY turn) AS proof FROM ordered GROUP BY row_
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN folded USING (row_) LEFT JOIN proofs USING (row_)
"""


def oracle() -> str:
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    whole = lambda text: "sha256(" + " || ".join(field.format(c) for c in (*FIELDS[:-1], text)) + ")"
    return ORACLE_SQL.format(leaf=whole("text"), forged=whole("low"), crc=crc32_sql("doc_id::VARCHAR"))
