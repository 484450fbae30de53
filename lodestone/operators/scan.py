"""Places and running sums in order, within groups of any size.

Rows are cut into ranges of (group, order), so that a group with very many rows lies in many tasks, each of which sorts its own
range. What a range adds to a group is summed up in a row for each range and group; sums over the ranges before it are the base
to which a range's own running values are added. A table without a group has a row for each range, and the only window without
PARTITION BY runs over these: no more rows than spark.sql.shuffle.partitions or `parts`.

The cut rows are written to the shared folder, so that all reads see the same ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lodestone.sources.shared import if_small, stored

_PART_BITS = 33  # monotonically_increasing_id holds the partition above them


def _same(group: list[str], side: str) -> Column:
    out = F.lit(True)
    for g in group:
        out = out & F.col(g).eqNullSafe(F.col(f"{side}{g}"))
    return out


def laid_out(rows: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows sorted within ranges of (group, order), nulls first, with _at, their place overall with gaps, and _part, their range.
    Rows that are equal in all of these may lie in any of their places."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    cut = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return stored(cut.withColumn("_part", F.shiftright("_at", _PART_BITS)), "ranges")


def _bases(cut: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """(_p, group, first place, the sums over the group's ranges before) for each range and group."""
    per = cut.groupBy("_part", *group).agg(F.min("_at").alias("_first"), *[c.alias(f"_b_{n}") for n, c in sums.items()])
    before = W.Window.partitionBy(*group).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    per = per.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)) for n in sums})
    return stored(per.select(F.col("_part").alias("_p"), "_first", *[f"_b_{n}" for n in sums], *[F.col(g).alias(f"_g_{g}") for g in group]), "range-bases")


def _with_bases(cut: DataFrame, bases: DataFrame, group: list[str]) -> DataFrame:
    width = 24 + 48 * (len(bases.columns) - 1)
    return cut.join(if_small(bases, bases.count(), width), (F.col("_part") == F.col("_p")) & _same(group, "_g_"))


def places(rows: DataFrame, group: list[str], order: list[str], name: str = "place", parts: int | None = None) -> DataFrame:
    """rows with their place from 0 within their group, by order (nulls first)."""
    columns = rows.columns
    cut = laid_out(rows, group, order, parts)
    met = _with_bases(cut, _bases(cut, group, {"n": F.count("*")}), group)
    return met.select(*columns, (F.col("_b_n") + F.col("_at") - F.col("_first")).alias(name))


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """rows with running sums, the own row included: {new column: summed column}. Nulls add nothing."""
    columns = rows.columns
    cut = laid_out(rows, group, order, parts)
    bases = _bases(cut, group, {n: F.sum(F.coalesce(F.col(c), F.lit(0))) for n, c in sums.items()})
    inside = W.Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    within = cut.withColumns({f"_r_{n}": F.sum(F.coalesce(F.col(c), F.lit(0))).over(inside) for n, c in sums.items()})
    met = _with_bases(within, bases, group)
    return met.select(*columns, *[(F.col(f"_b_{n}") + F.col(f"_r_{n}")).alias(n) for n in sums])


def previous(rows: DataFrame, order: list[str], columns: list[str], parts: int | None = None) -> DataFrame:
    """rows with {column}_before: the values of the row before by order, null for the first. A range's first row takes those
    of the last row of the ranges before it."""
    own = rows.columns
    cut = laid_out(rows, [], order, parts)
    inside = W.Window.partitionBy("_part").orderBy("_at")
    last = cut.groupBy("_part").agg(F.max_by(F.struct(*columns), "_at").alias("_last"))
    last = last.select((F.col("_part")).alias("_p"), F.lag("_last").over(W.Window.orderBy("_part")).alias("_last"))  # a row for each range
    met = cut.withColumn("_n", F.row_number().over(inside)).withColumn("_own", F.lag(F.struct(*columns)).over(inside))
    met = met.join(F.broadcast(last), F.col("_part") == F.col("_p")).withColumn("_own", F.when(F.col("_n") == 1, F.col("_last")).otherwise(F.col("_own")))
    return met.select(*own, *[F.col(f"_own.{c}").alias(f"{c}_before") for c in columns])
