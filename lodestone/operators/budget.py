"""Token budgets: fixed windows, the spending gate and the report.

Within a window the gate is monotone: while it is open the running sum is what was really spent, and once the limit is reached
nothing more is added. So the running sum before a request decides. Running sums have two levels: sums of buckets of seq, summed
over the buckets before, and then within each bucket, so that a caller with very many requests in one window is spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

BUCKET = 4096  # values of seq that are summed together


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time's own clock, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def window_id(ts: Column, seconds: int, origin: Column | int = 0) -> Column:
    """Number of the fixed window that a time falls in."""
    start = F.lit(origin) if isinstance(origin, int) else origin
    return F.floor((micros(ts) - start * 1_000_000) / (seconds * 1_000_000)).cast("long")


def with_limits(rows: DataFrame, limits: DataFrame, default: int) -> DataFrame:
    """rows (caller) with token_limit; the default where the caller has none of its own."""
    own = limits.select(F.col("caller").alias("_c"), F.col("token_limit").alias("_l"))
    return rows.join(own, F.col("caller") == F.col("_c"), "left").withColumn("token_limit", F.coalesce("_l", F.lit(default)).cast("long")).drop("_c", "_l")


def _running(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows (caller, win, seq, _bucket) with the sum of a column over the rows of the caller and window before each, else 0."""
    keys = ["caller", "win", "_bucket"]
    sums = rows.groupBy(*keys).agg(F.sum(column).alias("_s"))
    before = W.Window.partitionBy("caller", "win").orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_b{k}") for k in keys], F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    within = W.Window.partitionBy(*keys).orderBy("seq").rowsBetween(W.Window.unboundedPreceding, -1)
    on = [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in keys]
    rows = rows.withColumn("_within", F.coalesce(F.sum(column).over(within), F.lit(0))).join(sums, on, "left")
    return rows.withColumn(name, F.col("_base") + F.col("_within")).drop("_within", "_base", *[f"_b{k}" for k in keys])


def gate(rows: DataFrame) -> DataFrame:
    """rows (caller, win, seq, tokens, token_limit) with spent_before, allowed and spent. A limit of 0 or less never refuses;
    the request that crosses the limit is still served."""
    rows = _running(rows.withColumn("_bucket", F.floor(F.col("seq") / BUCKET)), "tokens", "_sum")
    allowed = (F.col("token_limit") <= 0) | (F.col("_sum") < F.col("token_limit"))
    rows = rows.withColumns({"allowed": allowed, "spent": F.when(allowed, F.col("tokens")).otherwise(0)})
    return _running(rows, "spent", "spent_before").drop("_sum", "_bucket")


def report(gated: DataFrame, limits: DataFrame, default: int, win: int | None = None) -> DataFrame:
    """Limit, spending and what remains (-1: unlimited) of each caller that has a limit of its own or spent anything, in
    one window or in each caller's last."""
    if win is None:
        last = gated.groupBy("caller").agg(F.max("win").alias("win"))
        rows = gated.join(last, ["caller", "win"])
    else:
        rows = gated.where(F.col("win") == win)
    spent = rows.groupBy("caller").agg(F.sum("spent").cast("long").alias("spent")).where("spent > 0")
    every = spent.join(limits.select("caller", F.col("token_limit").alias("_l")), "caller", "full_outer")
    limit = F.coalesce("_l", F.lit(default)).cast("long")
    every = every.select("caller", limit.alias("token_limit"), F.coalesce("spent", F.lit(0)).cast("long").alias("spent"))
    return every.withColumn("remaining", F.when(F.col("token_limit") <= 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.col("token_limit") - F.col("spent"))).cast("long"))


def reset_seconds(now: Column, seconds: int, origin: int = 0) -> Column:
    """Seconds until the window of a time ends."""
    return (window_id(now, seconds, origin) + 1) * seconds + origin - F.floor(micros(now) / 1_000_000)


def display(report: DataFrame, seconds: int, now: Column, origin: int = 0, caller: str = "caller") -> DataFrame:
    """A report for display: callers by eight hexadecimal digits of their hash, the first by the whole hash where digits
    clash, and the seconds until the window of `now` ends."""
    rows = report.withColumns({"_hash": F.sha2(caller, 256), "resets_in": reset_seconds(now, seconds, origin)})
    first = rows.groupBy(F.left("_hash", F.lit(8)).alias("shown")).agg(F.min(F.struct("_hash", *[c for c in rows.columns if c != "_hash"])).alias("r"))
    return first.select(F.col("shown").alias(caller), *[f"r.{c}" for c in rows.columns if c not in ("_hash", caller)])
