"""Cache lookups as joins: hits and misses, tiers, first-seen distinct keys, scattering and reassembly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.cost import cache_status


def live(expires_at: Column, now: Column) -> Column:
    """0 never expires; an entry still serves at its very expiry."""
    return (expires_at == 0) | (now <= expires_at)


def probe(items: DataFrame, cache: DataFrame, now: Column | None = None) -> DataFrame:
    """items (key) with hit: whether the cache holds a live entry of the key, and its raw value and tokens."""
    entries = cache if now is None else cache.where(live(F.col("expires_at"), now))
    entries = entries.select("key", F.col("raw").alias("raw"), F.col("tokens").alias("cached_tokens"), F.lit(True).alias("_hit"))
    return items.join(entries, "key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def hits(items: DataFrame, cache: DataFrame) -> DataFrame:
    return items.join(cache, "key", "left_semi")


def misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    return items.join(cache, "key", "left_anti")


def two_tiers(items: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """items with tier (near, far or none) and raw: the far tier answers what the near one misses."""
    n, f = near.select("key", F.col("raw").alias("_n")), far.select("key", F.col("raw").alias("_f"))
    rows = items.join(n, "key", "left").join(f, "key", "left")
    tier = F.when(F.col("_n").isNotNull(), "near").when(F.col("_f").isNotNull(), "far").otherwise("none")
    return rows.withColumns({"tier": tier, "raw": F.coalesce("_n", "_f")}).drop("_n", "_f")


def to_warm(items: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """Entries of the far tier that a lookup of these items copies to the near one."""
    return far.join(misses(items, near).select("key").distinct(), "key", "left_semi")


def distinct_missing(items: DataFrame, cache: DataFrame, batch: str, position: str) -> DataFrame:
    """Each batch's missing keys once, in order of first appearance."""
    return misses(items, cache).groupBy(batch, "key").agg(F.min(position).alias("first_pos"))


def scatter(items: DataFrame, computed: DataFrame) -> DataFrame:
    """Results (key, raw) back to every item of their key."""
    return items.join(computed.select("key", "raw"), "key")


def batch_status(probed: DataFrame, batch: str) -> DataFrame:
    """Hits, misses and status of each batch of probed items; repeats of a missing key within the batch are coalesced."""
    per_key = probed.groupBy(batch, "key", "hit").agg(F.count("*").alias("n"))
    rows = per_key.groupBy(batch).agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hits"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("n"))).alias("misses"), F.count_if(~F.col("hit")).alias("computed")
    )
    return rows.withColumn("status", cache_status(F.col("hits"), F.col("misses"), F.lit(0)))


def reassemble(results: DataFrame, batch: str, position: str, value: str) -> DataFrame:
    """Each batch's values as one array, in order of position."""
    ordered = F.sort_array(F.collect_list(F.struct(position, value)))
    return results.groupBy(batch).agg(F.transform(ordered, lambda s: s[value]).alias("values"))


def compare_bytes(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """Rows found on both sides, and those whose values differ."""
    x, y = a.select(*on, F.col(value).alias("_a")), b.select(*on, F.col(value).alias("_b"))
    return x.join(y, on).agg(F.count("*").alias("compared"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"))


def claim(wanted: DataFrame, in_flight: DataFrame) -> DataFrame:
    """wanted keys with owned: false where another request computes the key already."""
    flying = in_flight.select("key", F.lit(False).alias("_o"))
    return wanted.join(flying, "key", "left").withColumn("owned", F.coalesce("_o", F.lit(True))).drop("_o")


def allowed(requests: DataFrame, allow: DataFrame, credential: str = "credential", hashed: str = "key_hash") -> DataFrame:
    """requests with a verdict: ok, missing (no credential) or unknown (not on the list of hashed keys)."""
    from lodestone.functions.identity import credential_hash

    keys = allow.select(F.col(hashed).alias("_h")).distinct().withColumn("_ok", F.lit(True))
    rows = requests.withColumn("_c", credential_hash(F.trim(F.coalesce(F.col(credential), F.lit(""))))).join(keys, F.col("_c") == F.col("_h"), "left")
    verdict = F.when(F.trim(F.coalesce(F.col(credential), F.lit(""))) == "", "missing").when(F.col("_ok"), "ok").otherwise("unknown")
    return rows.withColumn("verdict", verdict).drop("_c", "_h", "_ok")


def cache_size(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).cast("long").alias("bytes"))


def coalesced_within(items: DataFrame, latency: float, at: str = "t") -> DataFrame:
    """items (key, seq, at in seconds) with owner: the seq of the request whose computation answers it. A computation takes
    `latency` seconds and is shared by requests that arrive meanwhile; later ones find the entry. So a key's first request
    computes; outcome is miss, coalesced or hit."""
    first = items.groupBy("key").agg(F.min(F.struct(at, "seq")).alias("_o"))
    rows = items.join(first, "key")
    own = F.col("seq") == F.col("_o.seq")
    outcome = F.when(own, "miss").when(F.col(at) <= F.col("_o")[at] + latency, "coalesced").otherwise("hit")
    return rows.withColumns({"owner": F.col("_o.seq"), "outcome": outcome}).drop("_o")


def coalesced_calls(items: DataFrame, latency: float, timeout: float | None = None, failed: Column | None = None, at: str = "t") -> DataFrame:
    """items (key, seq, at in seconds) with owner and outcome where computations may fail. An owner computes for `latency`
    seconds, and arrivals meanwhile wait for it. A failed computation (`failed`, a condition on the owner's row) fails its
    waiters, caches nothing, and the next arrival owns a new one. A waiter gives up if its owner takes more than `timeout`
    seconds from its arrival. Outcomes: miss, failed, coalesced, gave_up, hit.

    A fold over each key's arrivals, in order."""
    from lodestone.operators.replay import in_order

    def start():
        owner, since, bad, done = None, 0.0, False, None

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal owner, since, bad, done
            out = []
            for seq, t, fails in zip(pdf["seq"], pdf["t"], pdf["fails"], strict=True):
                if owner is not None and t <= since + latency:
                    late = timeout is not None and since + latency - t > timeout
                    out.append((owner, "gave_up" if late else "failed" if bad else "coalesced"))
                elif done is not None:
                    out.append((done, "hit"))
                else:
                    owner, since, bad = int(seq), float(t), bool(fails)
                    done = None if bad else owner
                    out.append((owner, "failed" if bad else "miss"))
            return pd.DataFrame({"key": pdf["key"], "seq": pdf["seq"], "owner": [o for o, _ in out], "outcome": [s for _, s in out]})

        return step

    fails = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    own = items.select("key", F.col("seq").cast("long").alias("seq"), F.col(at).cast("double").alias("t"), fails.alias("fails"))
    return in_order(own, "key", ["t", "seq"], "key string, seq long, owner long, outcome string", start)


def serving(found: DataFrame, cache: DataFrame, now: Column | None = None) -> DataFrame:
    """Nearest neighbours (q, c, similarity) with the entry that would be served: a neighbour whose entry was evicted or has
    expired is a plain miss, and no second-best one is tried."""
    entries = cache if now is None else cache.where(live(F.col("expires_at"), now))
    entries = entries.select(F.col("key").alias("c"), "raw", F.lit(True).alias("_live"))
    return found.join(entries, "c", "left").select("q", "c", "similarity", "raw", F.when(F.col("_live"), "semantic").otherwise("miss").alias("outcome"))
