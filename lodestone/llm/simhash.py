"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: bit k is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's word shingles.
Fingerprints that differ in at most RADIUS bits are linked, and documents linked through any chain are one class.

Search: the fingerprint is cut into two segments of 32 bits. Of two fingerprints at distance 3 or less, some segment
differs in at most one bit, so each fingerprint is looked up under the 33 values of the Hamming ball of radius 1 around
each segment, in a table keyed by segment and value, and complete distances are verified. The search runs over
distinct fingerprints, so copies cost nothing. A crowded table key (more than CROWD fingerprints) would pair all that
share it; for those, the other segment's parts extend the key, by the same pigeonhole argument, so no link is lost.
For classes, a task passes on only those of its links that join what its earlier ones did not, so a dense cluster leaves
about a link for each member and not one for each pair.

Classes: smallest labels are spread over the links and pointers are shortcut in rounds until nothing changes; each round
is a few joins and a min-aggregation over linked fingerprints, written to the shared folder. Neither links nor
fingerprints reach the driver. Documents meet their fingerprint's class by join_spread, so copies of one text, however
many, are joined where they are.

The filter reads texts where they lie and never shuffles them, however many rows it drops.

Defined results: texts that are null, empty or white space have fingerprint 0 and are linked like any other; fewer than
three words form one shingle; repeated rows share a class; a null doc_id gets a class id only from others; an empty
table gives no rows; other columns are ignored by the query and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import dealt, give_back_memory, join_spread, numbered, release, small_batches, stored, without_rows
from lodestone.sources.tables import spread

SHINGLE = 3
SEED = 42
RADIUS = 3
CROWD = 500
CHUNK_SHINGLES = 1 << 16
FOREST = 1 << 20  # fingerprints that a task remembers while it thins links


# --- fingerprints -------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of n words (all words, if fewer), lower-cased in A-Z, joined by single spaces."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-n])]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends[n - 1 :])), repeat(SEED)), np.uint64, len(words) - n + 1)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK_SHINGLES):
        own = hashes[k : k + CHUNK_SHINGLES]
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def simhash(text: bytes) -> int:
    hashes = shingle_hashes(text)
    return int(_POWERS[2 * _bit_counts(hashes) > len(hashes)].sum()) if len(hashes) else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, the last column, gives way to its fingerprint."""
    for n, batch in enumerate(batches):
        *keep, texts = batch.columns
        found = np.fromiter((simhash(t.as_py() or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*keep, pa.array(found)], names=[*batch.schema.names[:-1], "fp"])
        if n % 8 == 7:
            give_back_memory()
    give_back_memory()


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the fingerprint of each text as a signed long, stored."""
    rows = spread(docs.select(*keep, F.col("text").cast("binary").alias("fp")))
    with small_batches(docs.sparkSession):
        return stored(rows.mapInArrow(_fingerprints, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])), "fingerprints")


# --- links --------------------------------------------------------------------------------------------------


def _halves(fp: Column) -> list[tuple[Column, Column]]:
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return [(low, high), (high, low)]


def _ball(value: Column, bits: int) -> Column:
    """The value and those that differ from it in one of its bits."""
    return F.array(value, *[value.bitwiseXOR(F.lit(1 << b)) for b in range(bits)])


def _field(value: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << bits) - 1))


def _close(a: Column, b: Column) -> Column:
    return (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)


def _rows(fps: DataFrame, keys: list[Column]) -> DataFrame:
    """A row (key, fp) for each of the given arrays' elements."""
    return fps.select(F.explode(F.concat(*keys)).alias("key"), "fp")


def _tag(segment: int, value: Column) -> Column:
    return value.bitwiseOR(F.lit(segment << 32))


def _tags(segment: int, values: Column) -> Column:
    return F.transform(values, lambda v: _tag(segment, v))


def links(fps: DataFrame, thin: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints `fp` that differ in at most RADIUS bits; `thin`: only as many as it
    takes to join all that they join."""
    fp = F.col("fp")
    table = _rows(fps, [F.array(_tag(s, own)) for s, (own, _) in enumerate(_halves(fp))])
    crowded = table.groupBy("key").count().where(F.col("count") > CROWD).select("key")
    crowded = stored(crowded, "simhash-crowded")
    probes = _rows(dealt(fps), [_tags(s, _ball(own, 32)) for s, (own, _) in enumerate(_halves(fp))])
    if crowded.isEmpty():
        return _verified(probes, table, thin=thin)
    # A key is crowded if many fingerprints share it; every pair meets under the key of the table's side.
    calm = _verified(probes, table.join(crowded, "key", "left_anti"), thin=thin)
    return calm.unionByName(_crowded_links(table.join(crowded, "key", "left_semi"), probes.join(crowded, "key", "left_semi"), thin)).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those of a task's links that join what the ones before them did not."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for batch in batches:
        joins = []
        for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            x, y = top(a), top(b)
            if x != y:
                above[max(x, y)] = min(x, y)
                joins.append(k)
        if len(above) > FOREST:
            above.clear()
        if joins:
            yield batch.take(pa.array(joins))


def _verified(probes: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("key",), thin: bool = False) -> DataFrame:
    met = probes.withColumnRenamed("fp", "p").join(table.withColumnRenamed("fp", "t"), list(keys))
    a, b = F.least("p", "t"), F.greatest("p", "t")
    found = met.select(a.alias("a"), b.alias("b")).where(_close(F.col("a"), F.col("b")))
    return (found.mapInArrow(_forest, "a long, b long") if thin else found).distinct()


def _crowded_links(table: DataFrame, probes: DataFrame, thin: bool) -> DataFrame:
    """Links under crowded keys: where the key's segment is equal, the other segment differs in at most 3 bits, so one of
    its halves in at most 1; where it differs in one bit, the other differs in at most 2, so one of its thirds in none."""
    fp = F.col("fp")
    segment, value = F.shiftrightunsigned("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    (low, high), _ = _halves(fp)
    own, other = F.when(segment == 0, low).otherwise(high), F.when(segment == 0, high).otherwise(low)
    wide, third = [(0, 16), (16, 16)], [(0, 11), (11, 11), (22, 10)]

    def sub(df: DataFrame, parts: list[tuple[int, int]], spread) -> DataFrame:
        return df.withColumn("sub", F.explode(F.concat(*[_tags(k, spread(_field(other, at, n), n)) for k, (at, n) in enumerate(parts)])))

    def one(value: Column, bits: int) -> Column:
        return F.array(value)

    same = _verified(sub(probes.where(own == value), wide, _ball), sub(table, wide, one), ("key", "sub"), thin)
    near = _verified(sub(probes.where(own != value), third, one), sub(table, third, one), ("key", "sub"), thin)
    return same.unionByName(near)


# --- classes ------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its connected component.

    Rounds of hooking and shortcutting: each node's parent becomes the smallest of its own, its parent's parent and the
    parents of its neighbours, and a parent learns of smaller ones from its children."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, "links")
    state = old = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        up = state.select(F.col("node").alias("root"), F.col("root").alias("above"))
        lifted = state.join(up, "root").select("node", "root", "above")
        heard = both.join(lifted.select(F.col("node").alias("b"), F.col("above").alias("offer")), "b").groupBy("a").agg(F.min("offer").alias("offer")).withColumnRenamed("a", "node")
        told = lifted.join(heard, "node").select("node", "root", F.least("above", "offer").alias("best"))
        told = stored(told, "told")
        offers = told.select("node", "best").unionByName(told.select(F.col("root").alias("node"), "best"))
        new = offers.groupBy("node").agg(F.min("best").alias("best"))
        new = stored(new.join(told.select("node", "root"), "node").select("node", F.col("best").alias("now"), F.col("root").alias("was")), "roots")
        release(told, old)
        old, state = new, new.select("node", F.col("now").alias("root"))
        if new.where("now <> was").isEmpty():
            release(both)
            return state


def classified(rows: DataFrame, pick: Column) -> DataFrame:
    """fp, n, first and root for every fingerprint of the rows (fp): how many rows have it, the least `pick` of them, and
    the smallest fingerprint that its links reach."""
    fps = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(pick).alias("first")), "distinct-fingerprints")
    found = stored(links(fps.select("fp"), thin=True), "simhash-links")
    roots = components(found)
    known = stored(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    release(fps, found)
    return known


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that its links reach, for every row."""
    rows = fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    known = classified(rows, F.col("doc_id"))
    total = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    firsts = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(join_spread(known.select("fp", "root"), firsts, "root", total[0]).select("fp", "component_id"), "fingerprint-classes")
    return join_spread(rows, named, "fp", total[1]).select("doc_id", "fp", "component_id")


def op3_simhash(docs: DataFrame) -> DataFrame:
    return classes(docs.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: that of the class's smallest doc_id, the first by a hash of its text where rows share the id.
    Rows without an id stay where a class has no other. Rows are told apart by their place, not by their ids."""
    rows, (file, at) = numbered(docs)
    own = rows.select(F.col(file).alias("file"), F.col(at).alias("at"), "doc_id", F.xxhash64("text").alias("digest"), "text")
    prints = fingerprints(own, "file", "at", "doc_id", "digest")
    known = classified(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "file", "at"))
    kept = known.groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.at")
    dropped = stored(prints.select("file", "at").join(kept, ["file", "at"], "left_anti"), "simhash-dropped")
    release(prints, known)
    return without_rows(rows, [file, at], dropped).select(*docs.columns)
