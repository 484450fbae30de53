"""Exact top-k inner-product search by norm-bucketed retrieval.

Candidates are range-partitioned by falling norm and cut into buckets of a 32nd of them, of LEAST to BUCKET vectors, so a
bucket's lengths are alike and a common vector fills several buckets. For each query and bucket, the score to beat gives a local cosine
threshold: score / (query norm * the bucket's largest norm). Over 1, the bucket is skipped. At COORDINATE or more, the
bucket is pruned by coordinates: a vector that near to the query must have each coordinate in a narrow range, so sorted
lists of the query's strongest coordinates give the few to verify. Below, it is pruned by length: only the prefix
of vectors that are long enough is verified. Products are exact integers.

The first pass gives each query a score to beat: the buckets of the longest vectors are searched for all queries. The
second pass meets the other buckets, in blocks of about QUERY_BLOCK queries that need candidates of like length: a bucket
whose longest vector is too short for all of a block is not joined with it at all. Blocks are broadcast while they are measured
to be small; else buckets and blocks are dealt out by block, dimension and a salt, so that no block's buckets meet in one
task. Every task keeps the best k of each of its queries.

Vectors: each component x becomes floor(64 * x). Products are taken in floats while they are exact (below 2**53), else in
Python integers; a score beyond 64 bits is cut to them. Vectors of different lengths are not compared.

Defined results: vectors that are null or hold a null or non-finite component take no part; an empty vector neither; a
query never meets rows with its own id; an id that repeats among queries is answered once, by its smallest vector; repeated
candidates each count; ties go to the smaller id; fewer than k candidates give fewer rows; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lodestone.functions.text import let
from lodestone.llm.common import maybe_broadcast, stored

K = 20
LEAST, BUCKET = 64, 4096
QUERY_BLOCK = 2048
SALTS = 64
TILE = 512  # queries whose products with a bucket are held at once
COORDINATE = 0.85
FOCUS = 5  # strongest coordinates of a query that prune
EXACT = float(1 << 53)

BUCKETS = "bucket long, dim int, longest double, ids binary, rows binary"
FOUND = "query_id long, vec_id long, score long"


def scaled(vector: Column) -> Column:
    """floor(64 * x) of every component as doubles; null if the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(64.0) * x.cast("double")).cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), whole)


def _pack(bucket: int, dim: int, pdf: pd.DataFrame) -> dict:
    rows = np.array(pdf["v"].tolist(), np.float64)
    return {"bucket": bucket, "dim": dim, "longest": float(pdf["norm"].max()), "ids": pdf["vec_id"].to_numpy("<i8").tobytes(), "rows": rows.astype("<f8").tobytes()}


def _to_buckets(most: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, {}
        for pdf in batches:
            for dim, own in pdf.groupby("dim"):
                own = own if dim not in held else pd.concat([held.pop(dim), own])
                while len(own) >= most:
                    yield pd.DataFrame([_pack((part << 32) + n, dim, own.iloc[:most])])
                    own, n = own.iloc[most:], n + 1
                held[dim] = own
        for dim, own in held.items():
            if len(own):
                yield pd.DataFrame([_pack((part << 32) + n, dim, own)])
                n += 1

    return pack


def buckets(vectors: DataFrame, most: int = BUCKET) -> DataFrame:
    """Buckets of rows (vec_id, v, norm, dim): at most `most` vectors of one dimension, of neighbouring norms."""
    ordered = vectors.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    return ordered.mapInPandas(_to_buckets(most), BUCKETS)


def _unpack(ids: bytes, rows: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<f8").reshape(-1, dim)


class Bucket:
    """Vectors of neighbouring norms, longest first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.norms = np.sqrt((rows**2).sum(axis=1))
        self.by_coordinate: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _sorted(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.by_coordinate:
            unit = self.rows[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(unit, kind="stable")
            self.by_coordinate[f] = (unit[order], order)
        return self.by_coordinate[f]

    def near(self, q: np.ndarray, norm: float, t: float) -> np.ndarray:
        """Rows whose cosine with q may be t or more: each strong coordinate must lie in the range that a cosine of t leaves."""
        unit = q / norm
        counts = np.zeros(len(self.ids), np.int64)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for f in focus:
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2)))
            low, high = unit[f] * t - spread, unit[f] * t + spread
            # Beyond the pole of the cap, a larger cosine moves the bound inwards, so the pole itself must stay inside.
            low, high = (-1.0 if unit[f] <= -t else low), (1.0 if unit[f] >= t else high)
            values, order = self._sorted(f)
            counts[order[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, side="right")]] += 1
        return np.flatnonzero(counts == len(focus))


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as int64."""
    if not len(q) or not len(rows) or np.sqrt((q**2).sum(axis=1)).max() * np.sqrt((rows**2).sum(axis=1)).max() < EXACT / 4 and max(np.abs(q).max(), np.abs(rows).max()) < 2**31:
        return np.rint(q @ rows.T).astype(np.int64)
    a, b = [[int(x) for x in v] for v in q], [[int(x) for x in v] for v in rows]
    top = (1 << 63) - 1
    return np.array([[max(-top, min(top, sum(x * y for x, y in zip(u, v, strict=True)))) for v in b] for u in a], np.int64).reshape(len(a), len(b))


class Best:
    """The best k (score, id) of each query of a block."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.copy()
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.waiting = np.zeros(n, np.int64)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.parts[q].append((scores, ids))
        self.waiting[q] += len(ids)
        if self.waiting[q] >= 2 * self.k:
            self.settle(q)

    def settle(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        scores, ids = (np.concatenate(x) for x in zip(*self.parts[q], strict=True)) if self.parts[q] else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = np.lexsort((ids, -scores))[: self.k]
        self.parts[q] = [(scores[best], ids[best])]
        self.waiting[q] = len(best)
        if len(best) == self.k:
            self.floor[q] = max(self.floor[q], float(scores[best[-1]]))
        return self.parts[q][0]


def search(bucket: Bucket, q_ids: np.ndarray, q: np.ndarray, best: Best) -> None:
    """Adds to best all rows of the bucket that may be among a query's best k."""
    norms = np.sqrt((q**2).sum(axis=1))
    longest = bucket.norms[0] if len(bucket.norms) else 0.0
    for start in range(0, len(q), TILE):
        own = np.arange(start, min(start + TILE, len(q)))
        floor, n = best.floor[own], np.maximum(norms[own], 1e-300)
        with np.errstate(over="ignore", invalid="ignore"):
            local = np.where(np.isfinite(floor), floor / (n * max(longest, 1e-300)), -np.inf)
        able = local <= 1 + 1e-9
        for k in own[able & (local >= COORDINATE)]:
            rows = bucket.near(q[k], norms[k], min(1.0, float(local[k - start])))
            if len(rows):
                scores = products(q[k : k + 1], bucket.rows[rows])[0]
                keep = (scores >= best.floor[k]) & (bucket.ids[rows] != q_ids[k])
                best.add(k, scores[keep], bucket.ids[rows][keep])
        rest = own[able & (local < COORDINATE)]
        if not len(rest):
            continue
        least = np.where(floor[rest - start] > 0, floor[rest - start] / n[rest - start], -np.inf)
        reach = int(np.searchsorted(-bucket.norms, -(least.min() * (1 - 1e-9) if np.isfinite(least.min()) else least.min()), side="right"))
        scores = products(q[rest], bucket.rows[:reach])
        ids = bucket.ids[:reach]
        for j, k in enumerate(rest):
            hit = np.flatnonzero((scores[j] >= best.floor[k]) & (ids != q_ids[k]))
            if len(hit) > 4 * best.k:  # what cannot be among the k best of this bucket alone goes before the ids are compared
                cut = -np.partition(-scores[j][hit], best.k - 1)[best.k - 1]
                hit = hit[scores[j][hit] >= cut]
            if len(hit):
                best.add(k, scores[j][hit], ids[hit])


def _searcher(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows are pairs of a query block and a bucket; each task keeps the best k of every query that it meets."""
        held: dict[tuple, tuple] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.block, r.dim) not in held:
                    q_ids, q = _unpack(r.q_ids, r.q_rows, r.dim)
                    held[r.block, r.dim] = (q_ids, q, Best(len(q_ids), k, np.frombuffer(r.floors, "<f8")))
                search(Bucket(*_unpack(r.ids, r.rows, r.dim)), *held[r.block, r.dim])
        for q_ids, _, best in held.values():
            found = [(best.settle(i), i) for i in range(len(q_ids))]
            yield pd.DataFrame({"query_id": np.repeat(q_ids, [len(s) for (s, _), _ in found]), "vec_id": np.concatenate([v for (_, v), _ in found]), "score": np.concatenate([s for (s, _), _ in found])})

    return run


def _to_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    rows = np.array(pdf["v"].tolist(), "<f8")
    return pd.DataFrame([{"block": pdf["block"].iloc[0], "dim": pdf["dim"].iloc[0], "least": float(pdf["need"].min()), "q_ids": pdf["vec_id"].to_numpy("<i8").tobytes(), "q_rows": rows.tobytes(), "floors": pdf["floor"].fillna(-np.inf).to_numpy("<f8").tobytes()}])


def _below(need: Column, cuts: list[float]) -> tuple[Column, Column]:
    """How many of the sorted cuts are smaller than need, and how many are no larger: two binary searches in one literal array,
    so that the expression does not grow with the cuts."""
    if not cuts:
        return F.lit(0), F.lit(0)
    held = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    steps = F.split(F.lit(",".join(str(1 << k) for k in reversed(range(len(cuts).bit_length())))), ",").cast("array<int>")

    def search(array: Column, small) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(small(F.get(array, at + step - 1)), at + step).otherwise(at))

    return let(held, lambda array: search(array, lambda cut: cut < need)), let(held, lambda array: search(array, lambda cut: cut <= need))


def _blocks(queries: DataFrame, n: int) -> DataFrame:
    """n query rows (vec_id, v, dim, floor) as blocks of about QUERY_BLOCK, by the length that a candidate needs to beat their
    floors; queries of one need are dealt out among the blocks that share it."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    need = F.when((F.col("floor") > 0) & (norm > 0), F.col("floor") / norm * (1 - 1e-9)).otherwise(F.lit(float("-inf")))
    rows = queries.withColumn("need", need)
    parts = -(-n // QUERY_BLOCK)
    cuts = rows.stat.approxQuantile("need", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    first, after = _below(F.col("need"), sorted(cuts))
    rows = rows.withColumn("block", (first + F.pmod(F.xxhash64("vec_id"), after - first + 1)).cast("long"))
    return rows.groupBy("block", "dim").applyInPandas(_to_block, "block long, dim int, least double, q_ids binary, q_rows binary, floors binary")


def _meet(cells: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The best of each query among the cells, and others that a task could not rule out."""
    blocks = stored(blocks, "topk-blocks")
    n, size = blocks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("q_rows") + F.octet_length("q_ids") + F.octet_length("floors")), F.lit(0))).first()
    few = maybe_broadcast(blocks, 1, size)
    if few is blocks:
        cells = cells.withColumn("salt", F.pmod("bucket", F.lit(SALTS)))
        few = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        wanted = cells.select("bucket", F.col("dim").alias("_dim"), "longest").join(F.broadcast(blocks.select("block", F.col("dim").alias("_d"), "least")), (F.col("_dim") == F.col("_d")) & (F.col("longest") >= F.col("least")))
        cells = cells.join(wanted.groupBy("bucket").agg(F.collect_set("block").alias("blocks")), "bucket").withColumn("block", F.explode("blocks"))
        pairs = cells.join(few, ["block", "dim", "salt"])
    else:
        pairs = cells.join(few, "dim").where("longest >= least")
    return pairs.select("block", "dim", "ids", "rows", "q_ids", "q_rows", "floors").mapInPandas(_searcher(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score over rows (vec_id, v): v as from scaled()."""
    rows = vectors.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = stored(rows.withColumns({"dim": F.size("v"), "norm": norm}), "topk-vectors")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n, n_rows = queries.count(), rows.count()
    cells = stored(buckets(rows.select("vec_id", "v", "norm", "dim"), min(BUCKET, max(LEAST, n_rows // 32))), "topk-buckets")

    # The longest vectors, a bucket or two, give each query a score to beat.
    longest = cells.select("bucket", "dim", "longest").orderBy(F.desc("longest"), "bucket").limit(2).collect()
    first = [r.bucket for r in longest]
    blank = queries.withColumn("floor", F.lit(None).cast("double"))
    start = stored(_meet(cells.where(F.col("bucket").isin(first)), _blocks(blank, n), k), "topk-start")
    floors = start.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(F.col("query_id").alias("vec_id"), F.get("s", F.lit(k - 1)).cast("double").alias("floor"))
    known = queries.join(floors, "vec_id", "left")
    rest = _meet(cells.where(~F.col("bucket").isin(first)), _blocks(known, n), k)
    return _best(start.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(embeddings: DataFrame, k: int = K) -> DataFrame:
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v"))
    return topk(vectors, F.col("vec_id") % 20 == 0, k)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
