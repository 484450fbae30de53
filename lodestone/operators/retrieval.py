"""Vector retrieval and its evaluation: cosine ranking, nDCG, recall, ranking identity.

Search is a join of blocks. Rows of the corpus are dealt to the nearest of PIVOTS of them, queries likewise, and packed into blocks of
vectors that point alike, each with its mean direction and the largest angle to it. By the triangle inequality of angles, no row of
a block is nearer to a query of another than the angle of the means less both spreads. Each block of queries first meets the
corpus block of the nearest mean, which gives each query a score to beat, and then only the blocks that may hold a better one.
Pairs of blocks are scored by matrix products, and a task passes on the best k that it has seen of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lodestone.operators.scan import places
from lodestone.sources.shared import BROADCAST_BYTES, stored

QUERY_BLOCK, ROW_BLOCK = 1024, 4096  # vectors of a block
PIVOTS = 64
SALTS = 64  # tasks among which the rows that a block of queries meets are dealt, where blocks of queries are too many to send to all
HELD = 64  # blocks of queries whose best rows a task remembers
SLACK = 1e-9  # by which a bound may be wrong in floating point
PACKED = "dim int, block long, mean array<double>, spread double, least double, ids binary, rows binary, floors binary"
FOUND = "qid long, id long, score double"


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of length 0 stay."""
    norms = np.linalg.norm(m, axis=1)
    return np.divide(m, norms[:, None], out=np.zeros_like(m), where=norms[:, None] > 0)


def _whole(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a vector of numbers, as (id, v, dim)."""
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).select(F.col(key).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"))


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the PIVOTS rows of the smallest hashes, found among those whose hash lies under a share of all."""
    counts = [(r.dim, min(1 << 30, -(-(4 * PIVOTS << 30) // r["count"]))) for r in rows.groupBy("dim").count().collect()]  # a row for each dimension
    if not counts:
        return {}
    least = F.broadcast(rows.sparkSession.createDataFrame(counts, "dim int, most long"))
    found = rows.withColumn("_h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).join(least, "dim").where("_h < most").select("dim", "_h", "id", "v").collect()
    out: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["_h"], r.id)):
        out.setdefault(r.dim, []).append(r.v)
    return {d: _unit(np.array(v[:PIVOTS], np.float64)) for d, v in out.items()}


def _cells(pivots: dict[int, np.ndarray]):
    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        """The pivot that a vector is nearest to; vectors without direction are nearest to none."""
        out = np.full(len(v), -1, np.int32)
        sizes = v.map(len).to_numpy() if len(v) else np.zeros(0)
        for d, p in pivots.items():
            own = np.flatnonzero(sizes == d)
            if len(own):
                m = np.array(v.iloc[own].tolist(), np.float64)
                out[own] = np.where(np.abs(m).sum(axis=1) > 0, (_unit(m) @ p.T).argmax(axis=1), -1)
        return pd.Series(out)

    return nearest


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    m = _unit(np.array(pdf["v"].tolist(), np.float64))
    total = m.sum(axis=0)
    size = np.linalg.norm(total)
    mean = total / size if size > 0 else total
    zero = (np.abs(m).sum(axis=1) == 0).any() or size == 0  # no angle bounds these
    spread = np.pi if zero else float(np.arccos(np.clip(m @ mean, -1, 1)).max())
    floors = pdf["floor"].fillna(-np.inf).to_numpy("<f8")
    return pd.DataFrame([{"dim": int(pdf["dim"].iloc[0]), "block": int(pdf["block"].iloc[0]), "mean": mean.tolist(), "spread": spread, "least": float(floors.min()), "ids": pdf["id"].to_numpy("<i8").tobytes(), "rows": m.astype("<f8").tobytes(), "floors": floors.tobytes()}])


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """rows (id, v, dim, cell, floor) as blocks of about `size` vectors of one cell."""
    counts = {(r.dim, r.cell): -(-r.n // size) for r in rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}  # PIVOTS rows for each dimension
    if not counts:
        return rows.sparkSession.createDataFrame([], PACKED)
    spark = rows.sparkSession
    base, first = 0, []
    for (dim, cell), n in sorted(counts.items()):
        first.append((dim, cell, base, n))
        base += n
    parts = spark.createDataFrame(first, "dim int, cell int, first long, parts long")
    placed = rows.join(F.broadcast(parts), ["dim", "cell"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("id", F.lit("block")), "parts"))
    return placed.select("dim", "block", "id", "v", "floor").groupBy("dim", "block").applyInPandas(lambda pdf: _pack(pdf), PACKED)


class _Best:
    """The best k rows of each query of a block, by score at 12 digits, then id."""

    def __init__(self, ids: np.ndarray, floors: np.ndarray, k: int) -> None:
        self.ids, self.k, self.floor = ids, k, floors.copy()
        self.parts: list[list] = [[] for _ in ids]
        self.waiting = np.zeros(len(ids), np.int64)

    def settle(self, q: int) -> tuple:
        own, score, by = (np.concatenate(x) for x in zip(*self.parts[q], strict=True))
        best = np.lexsort((own, -by))[: self.k]
        self.parts[q], self.waiting[q] = [(own[best], score[best], by[best])], len(best)
        if len(best) == self.k:
            self.floor[q] = max(self.floor[q], by[best[-1]])
        return self.parts[q][0]

    def meet(self, unit: np.ndarray, ids: np.ndarray, rows: np.ndarray, others: bool) -> None:
        scores = unit @ rows.T
        by = np.round(scores, 12)
        if others:
            by[self.ids[:, None] == ids] = -np.inf
        cut = np.maximum(self.floor, np.partition(by, by.shape[1] - self.k, axis=1)[:, -self.k] if by.shape[1] > self.k else -np.inf)
        hits = (by >= cut[:, None]) & (by > -np.inf)
        for q in np.flatnonzero(hits.any(axis=1)):
            at = np.flatnonzero(hits[q])
            self.parts[q].append((ids[at], scores[q, at], by[q, at]))
            self.waiting[q] += len(at)
            if self.waiting[q] >= 4 * self.k:
                self.settle(q)

    def rows(self) -> pd.DataFrame:
        found = [(q, self.settle(q)) for q in range(len(self.ids)) if self.parts[q]]
        if not found:
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return pd.DataFrame({"qid": np.repeat(self.ids[[q for q, _ in found]], [len(f[0]) for _, f in found]), "id": np.concatenate([f[0] for _, f in found]), "score": np.concatenate([f[1] for _, f in found])})


def _searcher(k: int, others: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows are pairs of a block of queries and one of the corpus."""
        held: dict[tuple, tuple] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                key = (r.dim, r.q_block)
                if key not in held:
                    if len(held) == HELD:
                        yield held.pop(next(iter(held)))[1].rows()
                    ids = np.frombuffer(r.q_ids, "<i8")
                    held[key] = (np.frombuffer(r.q_rows, "<f8").reshape(len(ids), -1), _Best(ids, np.frombuffer(r.q_floors, "<f8"), k))
                unit, best = held[key]
                own = np.frombuffer(r.ids, "<i8")
                best.meet(unit, own, np.frombuffer(r.rows, "<f8").reshape(len(own), -1), others)
        for _, best in held.values():
            yield best.rows()

    return run


def _meet(pairs: DataFrame, blocks: DataFrame, asked: DataFrame, k: int, others: bool) -> DataFrame:
    """The best of each query among the pairs (dim, block, q_block) of blocks."""
    q = asked.select(F.col("dim").alias("q_dim"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("floors").alias("q_floors"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("rows") + F.octet_length("ids") + F.octet_length("floors")), F.lit(0))).first()[0]
    lists = pairs.groupBy("dim", "block").agg(F.collect_list("q_block").alias("q_blocks"))  # numbers of blocks
    met = blocks.select("dim", "block", "ids", "rows").join(lists, ["dim", "block"])
    if size <= BROADCAST_BYTES:
        met = met.withColumn("q_block", F.explode("q_blocks")).join(F.broadcast(q.drop("q_dim")), "q_block")
    else:
        q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = met.withColumn("salt", F.pmod(F.col("block"), F.lit(SALTS)).cast("int")).withColumn("q_block", F.explode("q_blocks")).join(q.drop("q_dim"), ["q_block", "salt"])
    return met.select("dim", "ids", "rows", "q_block", "q_ids", "q_rows", "q_floors").mapInPandas(_searcher(k, others), FOUND)


def rank(queries: DataFrame, corpus: DataFrame, k: int, others: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k best rows (id, v) of the corpus for each query (qid, v) by cosine, score falling, then id; the
    cosine with a vector of length 0 is 0. Null vectors, those that hold nulls, and rows of another dimension than the query's
    are skipped, and with `others` the row whose id is the query's own. Ids of queries are distinct."""
    rows, asked = stored(_whole(corpus, "id"), "search-rows"), stored(_whole(queries, "qid"), "search-queries")
    cells = _cells(_pivots(rows))
    of = lambda df: df.withColumn("cell", cells("v")).withColumn("floor", F.lit(None).cast("double"))
    blocks = stored(_packed(of(rows), ROW_BLOCK), "search-blocks")
    celled = stored(of(asked), "search-cells")
    first = stored(_packed(celled, QUERY_BLOCK), "search-asked")

    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("mean", "q_mean", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))))
    means = blocks.select("dim", "block", "mean", "spread", (F.octet_length("ids") / 8).alias("n"))

    def grid(asked_blocks: DataFrame) -> DataFrame:
        """All pairs of blocks of one dimension, by their means, with the highest cosine that they may hold."""
        q = asked_blocks.select("dim", F.col("block").alias("q_block"), F.col("mean").alias("q_mean"), F.col("spread").alias("q_spread"), "least")
        gap = F.greatest(F.lit(0.0), F.col("angle") - F.col("spread") - F.col("q_spread") - SLACK)
        bound = F.when((F.col("spread") >= np.pi) | (F.col("q_spread") >= np.pi), 1.0).otherwise(F.cos(gap))
        return means.join(q, "dim").withColumn("angle", angle).withColumn("bound", bound)

    near = grid(first).groupBy("dim", "q_block").agg(F.min_by("block", F.struct((F.col("n") < k + 1).cast("int"), "angle", "block")).alias("block"))
    near = stored(near, "search-first")
    start = stored(_meet(near, blocks, first, k, others), "search-start")
    floors = start.groupBy("qid").agg(F.sort_array(F.collect_list(F.round("score", 12)), asc=False).alias("s"))  # at most k of a task, and a query lies in one
    floors = floors.select(F.col("qid").alias("id"), (F.get("s", F.lit(k - 1)) - SLACK).alias("floor"))
    known = stored(_packed(celled.drop("floor").join(floors, "id", "left").select(*celled.columns), QUERY_BLOCK), "search-known")
    rest = grid(known).where(F.col("bound") >= F.col("least") - SLACK).join(near, ["dim", "q_block", "block"], "left_anti")
    found = start.unionByName(_meet(rest.select("dim", "block", "q_block"), blocks, known, k, others))
    order = W.Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def argmax(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1").select("qid", "id", "score")


def judged(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """The ranking with the relevance of each row; 0 for rows without judgement."""
    r = qrels.select(F.col("query_id").alias("qid"), F.col("doc_id").alias("id"), "relevance")
    return ranking.join(r, ["qid", "id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def ndcg(ranking: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg) with linear gains; the ideal is taken from positive judgements, cut at k and at the ranking's length."""
    gain = lambda g, at: g / F.log2(at + 1)
    rows = judged(ranking, qrels)
    got = rows.groupBy("qid").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("relevance"), F.col("rank"))).otherwise(0.0)).alias("dcg"), F.max("rank").alias("ranked"))
    order = W.Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    ideal = qrels.where("relevance > 0").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)
    ideal = ideal.join(got.select(F.col("qid").alias("query_id"), "ranked"), "query_id").where("at <= ranked")
    ideal = ideal.groupBy(F.col("query_id").alias("qid")).agg(F.sum(gain(F.col("relevance"), F.col("at"))).alias("idcg"))
    return got.join(ideal, "qid", "left").select("qid", F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def recall(ranking: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    """(qid, recall): the share of a query's relevant rows among its first k; 0 without any."""
    relevant = qrels.where("relevance > 0").groupBy(F.col("query_id").alias("qid")).agg(F.count("*").alias("all"))
    found = judged(ranking, qrels).groupBy("qid").agg(F.count_if((F.col("relevance") > 0) & (F.col("rank") <= k)).alias("found"))
    return found.join(relevant, "qid", "left").select("qid", F.when(F.coalesce("all", F.lit(0)) > 0, F.col("found") / F.col("all")).otherwise(0.0).alias("recall"))


def _labelled(ranking: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(qid, dcg, ranked, found, all) where the rows (id, label) of a query's own label, but itself, are relevant: judged from
    the ranked rows and the sizes of labels, without a row for each pair of one label."""
    one, sizes = labels.select("id", "label"), labels.groupBy("label").agg((F.count("*") - 1).alias("all"))
    own = one.join(sizes, "label", "left").select(F.col("id").alias("qid"), F.col("label").alias("_q"), "all")
    rows = ranking.join(one, "id", "left").join(own, "qid", "left").withColumn("_r", F.coalesce(F.col("label") == F.col("_q"), F.lit(False)) & (F.col("rank") <= k))
    gain = F.when(F.col("_r"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    return rows.groupBy("qid").agg(F.sum(gain).alias("dcg"), F.max("rank").alias("ranked"), F.count_if("_r").alias("found"), F.coalesce(F.max("all"), F.lit(0)).alias("all"))


def labelled_ndcg(ranking: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """ndcg() with the judgements of _labelled."""
    rows = _labelled(ranking, labels, k).withColumn("_n", F.least("all", F.lit(k), "ranked").cast("int"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("_n")), F.lit(0.0), lambda a, at: a + 1 / F.log2(at + 1))
    return rows.select("qid", F.when(F.col("_n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def labelled_recall(ranking: DataFrame, labels: DataFrame, k: int = 100) -> DataFrame:
    """recall() with the judgements of _labelled."""
    return _labelled(ranking, labels, k).select("qid", F.when(F.col("all") > 0, F.col("found") / F.col("all")).otherwise(0.0).alias("recall"))


def evaluate_labelled(ranking: DataFrame, labels: DataFrame, k_ndcg: int = 10, k_recall: int = 100) -> DataFrame:
    """evaluate() where the rows (id, label) of a query's own label are relevant; of rows that also have `judged`, queries
    where it is false do not count, nor do those whose label is theirs alone."""
    alone = labels.groupBy("label").count().where("count > 1").select("label")
    counted = labels.where("judged") if "judged" in labels.columns else labels
    counted = counted.join(alone, "label", "left_semi").select(F.col("id").alias("qid"))
    rows = labelled_ndcg(ranking, labels, k_ndcg).join(labelled_recall(ranking, labels, k_recall), "qid").join(counted, "qid", "left_semi")
    return rows.agg(F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"))


def evaluate(ranking: DataFrame, qrels: DataFrame, k_ndcg: int = 10, k_recall: int = 100) -> DataFrame:
    """Means over the ranked queries that have judgements."""
    has = qrels.select(F.col("query_id").alias("qid")).distinct()
    rows = ndcg(ranking, qrels, k_ndcg).join(recall(ranking, qrels, k_recall), "qid").join(has, "qid", "left_semi")
    return rows.agg(F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"))


def same_ranking(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Places compared and places that differ between two rankings, down to k."""
    x = a.where(F.col("rank") <= k).select("qid", "rank", F.col("id").alias("_a"))
    y = b.where(F.col("rank") <= k).select("qid", "rank", F.col("id").alias("_b"))
    return x.join(y, ["qid", "rank"], "full_outer").agg(F.count("*").alias("places"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("different"))


def expand_queries(queries: DataFrame, text: str, templates: list[str]) -> DataFrame:
    """Each query and its variants by template, {} standing for the text."""
    variants = [F.replace(F.lit(t), F.lit("{}"), F.col(text)) for t in templates]
    return queries.select("*", F.posexplode(F.array(F.col(text), *variants)).alias("variant", "variant_text"))


def merge_variants(results: DataFrame, query: str, text: str, score: str, most: int, prefix: int = 60) -> DataFrame:
    """Results of a query's variants as one list: best first, texts that share a prefix once."""
    rows = results.withColumn("_p", F.substring(text, 1, prefix))
    once = W.Window.partitionBy(query, "_p").orderBy(F.desc(score), text)
    best = W.Window.partitionBy(query).orderBy(F.desc(score), text)
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("place", F.row_number().over(best))
    return rows.where(F.col("place") <= most).drop("_p", "_n")


def batched(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with the number of their batch: `size` rows by order, whatever gaps and repeats the order columns have."""
    return places(stored(rows, "batches"), [], order, "batch").withColumn("batch", F.expr(f"batch div {size}"))
