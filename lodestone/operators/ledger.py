"""The item ledger and what is read off it: duplicates, waste, usage by model and caller, reports.

Where only counts are needed, keys are aggregated (with partial sums on the map side) instead of ranked, so that a frequent
key costs no long window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lodestone.functions.cost import cost, percent
from lodestone.functions.identity import text_key
from lodestone.functions.text import estimate_tokens, normalize, preview
from lodestone.operators.scan import previous
from lodestone.sources.shared import if_small, release, stored


def keyed(items: DataFrame, rules: str = "") -> DataFrame:
    """items (seq, model, text) with key and est_tokens."""
    return items.withColumns({"key": text_key(F.col("model"), normalize(F.col("text"), rules)), "est_tokens": estimate_tokens(F.col("text"))})


def by_key(items: DataFrame, *more: Column) -> DataFrame:
    """A row for each key: occurrences, tokens of all and of the first, the first seq."""
    first = F.struct("seq", "est_tokens")
    rows = items.groupBy("key", "model").agg(F.count("*").alias("n"), F.sum("est_tokens").alias("tokens"), F.min(first).alias("_first"), *more)
    return rows.withColumns({"first_seq": F.col("_first.seq"), "first_tokens": F.col("_first.est_tokens")}).drop("_first")


def _totals() -> list[Column]:
    return [
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("items"),
        F.count("*").alias("unique_items"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("dup_items"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.sum(F.col("tokens") - F.col("first_tokens")), F.lit(0)).cast("long").alias("wasted_tokens"),
    ]


def duplicate_summary(items: DataFrame) -> DataFrame:
    """Items, unique items, duplicates, their share, tokens and tokens wasted on repeats, by occurrence."""
    return by_key(items).agg(*_totals()).withColumn("dup_rate", F.when(F.col("items") > 0, F.col("dup_items") / F.col("items")).otherwise(0.0))


def duplicates_by_model(items: DataFrame, prices: dict[str, float] | None = None) -> DataFrame:
    return model_totals(by_key(items), prices)


def model_totals(keys: DataFrame, prices: dict[str, float] | None = None) -> DataFrame:
    """Totals by model over keys as by_key gives them."""
    rows = keys.groupBy("model").agg(*_totals())
    return rows.withColumns({"total_usd": cost(F.col("model"), F.col("total_tokens"), prices), "wasted_usd": cost(F.col("model"), F.col("wasted_tokens"), prices)})


def top_duplicates(items: DataFrame, n: int = 10) -> DataFrame:
    """The keys that waste most tokens: repeats times the tokens of the first occurrence; ties by key."""
    rows = by_key(items, F.min_by("text", "seq").alias("first_text")).where("n >= 2")
    rows = rows.withColumn("wasted", (F.col("n") - 1) * F.col("first_tokens")).orderBy(F.desc("wasted"), "key").limit(n)
    return rows.select("key", "model", F.col("n").alias("occurrences"), "first_tokens", F.col("wasted").alias("wasted_tokens"), preview(F.col("first_text")).alias("preview"))


def outcomes(items: DataFrame) -> DataFrame:
    """items with outcome: miss for a key's first occurrence, hit for the rest, and the tokens saved or spent. A key's first
    seq is aggregated and joined back, so that a frequent key's rows are never sorted in one task."""
    firsts = items.groupBy("key").agg(F.min("seq").alias("_first"))
    first = F.col("seq") == F.col("_first")
    rows = items.join(firsts, "key").select(*[items[c] for c in items.columns], "_first")
    return rows.withColumns({"outcome": F.when(first, "miss").otherwise("hit"), "spent": F.when(first, F.col("est_tokens")).otherwise(0), "saved": F.when(first, 0).otherwise(F.col("est_tokens"))}).drop("_first")


def usage(ledger: DataFrame, by: str, prices: dict[str, float] | None = None) -> DataFrame:
    """Items, hits, misses, tokens and money by a column; rows without it are left out. A bucket's hits hold coalesced and
    near-duplicate answers too."""
    answered = F.col("outcome") != "miss"
    rows = ledger.where(F.coalesce(F.col(by), F.lit("")) != "").groupBy(by).agg(
        F.count("*").alias("items"), F.count_if(answered).alias("hits"), F.count_if(~answered).alias("misses"), F.sum("saved").cast("long").alias("saved_tokens"), F.sum("spent").cast("long").alias("spent_tokens")
    )
    return rows.withColumn("saved_usd", cost(F.col(by), F.col("saved_tokens"), prices)) if by == "model" else rows


def first_buckets(ledger: DataFrame, by: str, most: int = 1000) -> DataFrame:
    """The ledger's rows of the first `most` values of a column by order of arrival."""
    firsts = ledger.groupBy(by).agg(F.min("seq").alias("_first")).orderBy("_first", by).limit(most).select(by)
    return ledger.join(firsts, by, "left_semi")


def savings_report(ledger: DataFrame, prices: dict[str, float] | None = None) -> DataFrame:
    """One row over all items: counts by outcome, hit rate, tokens, duplicate share and money."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    per_model = ledger.groupBy("model").agg(
        F.count("*").alias("n"), count("hit").alias("h"), count("semantic").alias("s"), count("coalesced").alias("c"), count("miss").alias("m"), F.sum("saved").alias("saved"), F.sum("spent").alias("spent")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    rows = per_model.agg(
        total("n").alias("items"), total(F.col("h") + F.col("s")).alias("hits"), total("m").alias("misses"), total("c").alias("coalesced"), total("saved").alias("saved_tokens"), total("spent").alias("spent_tokens"),
        F.coalesce(F.sum(cost(F.col("model"), F.col("saved"), prices)), F.lit(0.0)).alias("saved_usd"),
    )
    return rows.withColumns(
        {
            "hit_rate": F.when(F.col("items") > 0, (F.col("hits") + F.col("coalesced")) / F.col("items")).otherwise(0.0),
            "duplicate_share": percent(F.col("saved_tokens"), F.col("saved_tokens") + F.col("spent_tokens")) / 100.0,
        }
    )


CUTS = 64  # bins of a histogram that narrows a search for a percentile
LAST = 10_000  # distinct values that are put in order at the end of a search


def rank_floor_percentiles(rows: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Percentiles that are values of the data: the one at place int(p * (n - 1)) of the sorted values; nulls do not count. Values
    are counted first. A search for a place keeps an interval, cuts it at CUTS quantiles of the distinct values in it, and goes on
    with the bin that the place falls in, until no more than LAST distinct values are left: only those are ever ordered in
    one task, whatever the group's size. All groups and points are searched together."""
    by = by or []
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_"))
    as_double = F.col("v").cast("double")
    along = F.when(F.isnan(as_double), F.lit(float("inf"))).otherwise(as_double)  # rises with the value
    counts = rows.where(F.col(value).isNotNull()).groupBy(group.alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    counts = stored(counts.withColumn("d", along), "value-counts")
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.lit(p) * (F.col("n") - 1)).cast("long").alias("place")) for name, p in points.items()]))
    open_ = counts.groupBy("g").agg(F.sum("c").alias("n")).select("g", asked.alias("s")).select("g", "s.*", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    open_, found = stored(open_, "searches"), []
    running = lambda order: W.Window.partitionBy("g", "name").orderBy(order)
    while True:
        n = open_.count()
        if not n:
            break
        search = open_.withColumnRenamed("g", "_g")
        inside = counts.join(if_small(search, n, 96), F.col("g") == F.col("_g")).drop("_g")
        inside = inside.where((F.col("low").isNull() | (F.col("d") > F.col("low"))) & (F.col("high").isNull() | (F.col("d") <= F.col("high"))))
        sizes = inside.groupBy("g", "name").agg(F.count("*").alias("m"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.percentile_approx("d", [k / CUTS for k in range(1, CUTS)], 20 * CUTS).alias("cuts"))
        sizes = stored(sizes.withColumnRenamed("g", "_g").withColumnRenamed("name", "_name"), "search-sizes")
        met = inside.join(if_small(sizes, n, 96 + 8 * CUTS), (F.col("g") == F.col("_g")) & (F.col("name") == F.col("_name"))).drop("_g", "_name")
        last = (F.col("m") <= LAST) | (F.col("d0") == F.col("d1"))  # values of one double are few
        few = met.where(last).withColumn("upto", F.sum("c").over(running("v"))).where("upto > place")
        found.append(stored(few.groupBy("g", "name").agg(F.min("v").alias("v")), "search-found"))
        bins = met.where(~last).withColumn("bin", F.size(F.filter("cuts", lambda x: x < F.col("d"))))
        bins = bins.groupBy("g", "name", "place", "bin").agg(F.sum("c").alias("c"), F.max("d").alias("high"), F.min("d").alias("least"))  # CUTS rows at most
        bins = bins.withColumns({"upto": F.sum("c").over(running("bin")), "below": F.lag("high").over(running("bin"))}).withColumn("before", F.col("upto") - F.col("c"))
        hit = bins.where("before <= place AND place < upto").join(open_.select("g", "name", F.col("low").alias("old")), ["g", "name"])
        nxt = stored(hit.select("g", "name", (F.col("place") - F.col("before")).alias("place"), F.coalesce("below", "old").alias("low"), "high"), "searches")
        release(open_, sizes)
        open_ = nxt
    if not found:
        return rows.select(*by).distinct().limit(0).select(*by, *[F.lit(None).cast(rows.schema[value].dataType).alias(name) for name in points])
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    picked = [F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in points]
    return whole.groupBy("g").agg(*picked).select(*[F.col(f"g.{c}").alias(c) for c in by], *points)


def prometheus(report: DataFrame, prefix: str = "engine") -> DataFrame:
    """(metric, type, label, value) of a savings report, a sample in each row."""
    one = lambda name, kind, label, c: F.struct(F.lit(f"{prefix}_{name}").alias("metric"), F.lit(kind).alias("type"), F.lit(label).alias("label"), F.col(c).cast("double").alias("value"))
    samples = [one("items_total", "counter", r, c) for r, c in (("hit", "hits"), ("miss", "misses"), ("coalesced", "coalesced"))]
    samples += [one("saved_tokens_total", "counter", "", "saved_tokens"), one("spent_tokens_total", "counter", "", "spent_tokens"), one("saved_usd", "gauge", "", "saved_usd")]
    return report.select(F.inline(F.array(*samples)))


def render_prometheus(samples: DataFrame) -> str:
    """The exposition text of a few samples."""
    lines, seen = [], set()
    for r in samples.collect():
        if r.metric not in seen:
            seen.add(r.metric)
            lines.append(f"# TYPE {r.metric} {r.type}")
        label = f'{{result="{r.label}"}}' if r.label else ""
        lines.append(f"{r.metric}{label} {r.value:f}" if r.type == "gauge" else f"{r.metric}{label} {int(r.value)}")
    return "\n".join(lines) + "\n"


def render_summary(summary: DataFrame, top: DataFrame | None = None) -> str:
    """A text report of a duplicate summary and its top duplicates."""
    s = summary.first()
    lines = [f"items        {s['items']} ({s.unique_items} unique, {s.dup_items} duplicate, {100 * s.dup_rate:.1f} %)", f"tokens       {s.total_tokens} ({s.wasted_tokens} wasted)"]
    for r in top.collect() if top is not None else []:
        lines.append(f"{r.occurrences:>6} x {r.first_tokens:>6} tokens  {r.preview}")
    return "\n".join(lines) + "\n"


def counter_deltas(snapshots: DataFrame, order: str, counters: list[str]) -> DataFrame:
    """What each counter gained since the snapshot before; the first snapshot counts from zero."""
    columns = snapshots.columns
    rows = previous(stored(snapshots, "snapshots"), [order], counters)
    return rows.select(*columns, *[(F.col(c) - F.coalesce(f"{c}_before", F.lit(0))).alias(f"{c}_delta") for c in counters])
