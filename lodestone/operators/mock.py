"""The deterministic test backend and generated workloads."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.scan import places
from lodestone.sources.shared import stored


#: Inputs whose texts and vectors are held in Python at once.
AT_ONCE = 256


def vector(model: str, seed: str, dim: int) -> np.ndarray:
    """A vector that model and seed determine: SHA-256 blocks, each the digest of the one before, read as eight unsigned
    integers and scaled to -1 to 1 in single precision."""
    state, parts = hashlib.sha256(f"{model}\0{seed}".encode()).digest(), []
    for _ in range(-(-dim // 8)):
        parts.append(np.frombuffer(state, "<u4"))
        state = hashlib.sha256(state).digest()
    whole = np.concatenate(parts)[:dim] if parts else np.zeros(0, "<u4")
    return whole.astype(np.float32) / np.float32(2**32 - 1) * np.float32(2) - np.float32(1)


def token_seed(tokens: Column) -> Column:
    """The seed of a token input."""
    return F.concat(F.lit("tokens:["), F.array_join(F.transform(tokens, lambda t: t.cast("string")), " "), F.lit("]"))


def embed(model: Column, seed: Column, dim: int = 384, asked: int = 0) -> Column:
    """Vectors of inputs; a smaller asked dimension is honoured."""
    size = asked if 0 < asked < dim else dim

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for models, seeds in batches:
            for k in range(0, max(1, len(seeds)), AT_ONCE):  # a batch stays an Arrow buffer, and few texts at a time are read
                own = zip(models.slice(k, AT_ONCE).to_pylist(), seeds.slice(k, AT_ONCE).to_pylist(), strict=True)
                made = [vector(m or "", s or "", size) for m, s in own]
                flat = np.concatenate(made) if made else np.zeros(0, np.float32)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * size, pa.int32()), pa.array(flat, pa.float32()))

    return F.arrow_udf(run, "array<float>").asNondeterministic()(model, seed)  # so that it is not run again for filters on it


@F.pandas_udf(T.StringType())
def base64_floats(vectors: pd.Series) -> pd.Series:
    """Vectors as base64 of little-endian single-precision numbers."""
    return vectors.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats_of_base64(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), "<f4"))


def compute_missing(items: DataFrame, cache: DataFrame, dim: int = 384) -> DataFrame:
    """(key, v) for every key that the cache lacks, each computed once: keys are made distinct and anti-joined before the
    backend sees them."""
    missing = items.join(cache, "key", "left_anti").groupBy("key").agg(F.min_by("model", "seq").alias("model"), F.min_by("text", "seq").alias("text"))
    return missing.select("key", embed(F.col("model"), F.col("text"), dim).alias("v"))


#: Words of generated texts.
VOCABULARY = "river stone light paper winter engine garden signal copper window market thunder velvet anchor meadow cipher lantern harbor quartz ember saddle timber canyon ribbon falcon marble orchid".split()


def _hash(*parts: Column | str | int) -> Column:
    """60 bits of the MD5 of the parts, joined by bars; SQL engines find the same."""
    texts = [F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("long")


def corpus(spark: SparkSession, n: int, words: int = 40, seed: int = 1) -> DataFrame:
    """n texts of random words (id, text)."""
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    word = lambda i: F.get(vocabulary, F.pmod(_hash(seed, F.col("id"), i), F.lit(len(VOCABULARY))).cast("int"))
    return spark.range(n).withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), word), " "))


def zipf(spark: SparkSession, draws: int, pool: int, s: float = 1.1, seed: int = 1) -> DataFrame:
    """draws of ranks 0 to pool - 1 with probability falling as (rank + 1) ** -s: (seq, rank). A draw is found in the cumulated
    masses by a binary search."""

    @F.pandas_udf("int")
    def rank(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mass = np.cumsum(np.arange(1, pool + 1) ** -s)
        for u in batches:
            yield pd.Series(np.minimum(np.searchsorted(mass / mass[-1], u.to_numpy(), side="right"), pool - 1).astype(np.int32))

    u = _hash(seed, F.col("id")) / float(1 << 60)
    return spark.range(draws).select(F.col("id").alias("seq"), rank(u).alias("rank"))


def edited(rows: DataFrame, id_: str, text: str, share: float, seed: int = 1) -> DataFrame:
    """rows with about a share of the texts edited at the end."""
    chosen = F.pmod(_hash(seed, F.col(id_)), F.lit(10_000)) < int(share * 10_000)
    return rows.withColumn(text, F.when(chosen, F.concat(F.col(text), F.lit(" edited"))).otherwise(F.col(text)))


def hostile(rows: DataFrame, id_: str, good: str, bad: float = 0.2, empty: float = 0.05, seed: int = 1) -> DataFrame:
    """rows with a credential: a share of wrong ones, a share of empty ones, the rest good."""
    at = F.pmod(_hash(seed, F.col(id_)), F.lit(10_000)) / 10_000.0
    return rows.withColumn("credential", F.when(at < bad, F.concat(F.lit("bad-"), F.col(id_).cast("string"))).when(at < bad + empty, "").otherwise(good))


def sessions(spark: SparkSession, n: int, turns: int, repeat: float = 0.45, seed: int = 1) -> DataFrame:
    """(session, turn, intent): in a share of turns an intent of an earlier session comes back."""
    rows = spark.range(n).select(F.col("id").alias("session"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    own = F.col("session") * turns + F.col("turn")
    again = F.pmod(_hash(seed, own), F.lit(1000)) < int(1000 * repeat)
    return rows.withColumn("intent", F.when(again & (own > 0), F.pmod(_hash(seed, 2, own), F.greatest(own, F.lit(1)))).otherwise(own))


def edited_exactly(rows: DataFrame, id_: str, text: str, share: float, seed: int = 1) -> DataFrame:
    """rows with exactly floor(share * n) of the texts edited at the end: those of the smallest hashes of their id, ties by id and
    text, so that rows of one id are counted one by one."""
    columns = rows.columns
    placed = places(stored(rows.withColumn("_h", _hash(seed, F.col(id_))), "workload"), [], ["_h", id_, text], "_nth")
    wanted = int(placed.count() * share)
    return placed.withColumn(text, F.when(F.col("_nth") < wanted, F.concat(F.col(text), F.lit(" edited"))).otherwise(F.col(text))).select(*columns)
