"""Money and token accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# USD for a million tokens of each known model, and of any other.
PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10}
DEFAULT_PRICE = 0.02


def cost(model: Column, tokens: Column, prices: dict[str, float] | None = None, default: float = DEFAULT_PRICE) -> Column:
    """USD of tokens at a price list small enough to stand in the plan."""
    prices = PRICES if prices is None else prices
    price = F.lit(default)
    for name, value in prices.items():
        price = F.when(model == name, F.lit(value)).otherwise(price)
    return tokens * price / 1e6


def with_cost(df: DataFrame, prices: DataFrame, model: str, tokens: str, default: float = DEFAULT_PRICE, name: str = "usd") -> DataFrame:
    """df with the cost of its tokens by a price table (model, price)."""
    p = prices.select(F.col("model").alias("_m"), F.col("price").alias("_p"))
    return df.join(p, F.col(model) == F.col("_m"), "left").withColumn(name, F.col(tokens) * F.coalesce("_p", F.lit(default)) / 1e6).drop("_m", "_p")


def apportion(items: DataFrame, batch: str, position: str, estimate: str, total: str, name: str = "share") -> DataFrame:
    """Splits each batch's total over its items by largest remainders of their estimates; ties go to the earlier position.
    Without a positive total, items keep their estimates."""
    whole = W.Window.partitionBy(batch)
    e, t = F.col(estimate), F.col(total)
    base = F.expr(f"{total} * {estimate} div _sum")
    rows = items.withColumn("_sum", F.sum(estimate).over(whole))
    rows = rows.withColumns({"_base": base, "_rem": t * e % F.col("_sum")})
    rows = rows.withColumns({"_left": t - F.sum("_base").over(whole), "_rank": F.row_number().over(whole.orderBy(F.desc("_rem"), position))})
    return rows.withColumn(name, F.when(t <= 0, e).otherwise(F.col("_base") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_sum", "_base", "_rem", "_left", "_rank")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def drift(estimated: Column, real: Column) -> Column:
    return 100.0 * (estimated - real) / real


def backoff_ms(attempt: Column, retry_after_s: Column | None = None) -> Column:
    """Wait before an attempt: what the server asks for, up to 5 s; else 250 ms doubling up to 4 s. Jitter is left out."""
    own = F.least(F.lit(4000.0), 250.0 * F.pow(F.lit(2.0), attempt - 1))
    return own if retry_after_s is None else F.when(retry_after_s.isNotNull(), F.least(retry_after_s * 1000.0, F.lit(5000.0))).otherwise(own)


def upstream_fault(status: Column) -> Column:
    """Throttled, failing or unreachable (no status)."""
    return status.isNull() | (status == 429) | (status >= 500)


def cache_status(hits: Column, misses: Column, coalesced: Column) -> Column:
    return F.when((misses == 0) & (hits + coalesced > 0), "hit").when((hits == 0) & (coalesced == 0), "miss").otherwise("partial")
