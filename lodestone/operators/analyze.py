"""Offline analysis of request logs: from lines to requests, items, duplicates, tokens and money.

A line without a request, or with one whose input has none of the known shapes, is skipped and counted. Items are identified by
model, dimensions, encoding, parameters and their text or tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import identity, text
from lodestone.functions.cost import cost
from lodestone.operators import ledger
from lodestone.sources import requests
from lodestone.sources.deltas import DeltaTable
from lodestone.sources.shared import stored


def parsed(lines: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """lines (seq, value) with the fields of their request and n_items, 0 for lines that are skipped."""
    rows = requests.read(lines, ignore)
    return rows.withColumn("n_items", F.when(F.col("request").isNotNull(), F.coalesce(requests.n_items(F.col("input")), F.lit(0))).otherwise(0))


def token_preview(tokens: Column) -> Column:
    return F.format_string("<%d pre-tokenized tokens>", F.size(tokens))


def _keyed(own: DataFrame, rules: str) -> DataFrame:
    """Exploded items with key, est_tokens and preview."""
    digest = identity.params_digest(F.col("params"))
    head = (F.col("dimensions"), F.col("encoding_format"), F.col("digest"))
    key = F.when(F.col("is_tokens"), identity.token_key(F.col("model"), F.col("tokens"), *head)).otherwise(identity.text_key(F.col("model"), text.normalize(F.col("text"), rules), *head))
    estimate = F.when(F.col("is_tokens"), text.estimate_token_items(F.col("tokens"))).otherwise(text.estimate_tokens(F.col("text")))
    shown = F.when(F.col("is_tokens"), token_preview(F.col("tokens"))).otherwise(text.preview(F.col("text")))
    return own.withColumn("digest", digest).select(F.struct("seq", "pos").alias("seq"), "model", key.alias("key"), estimate.cast("long").alias("est_tokens"), shown.alias("preview"))


def items(rows: DataFrame, rules: str = "") -> DataFrame:
    """The item ledger of parsed lines: seq (line and position), model, key, est_tokens, preview."""
    return _keyed(requests.items(rows), rules)


def state(lines: DataFrame, rules: str = "", ignore: tuple[str, ...] = ()) -> DataFrame:
    """What an analysis needs to know of log lines (seq, value), as a table that adds up (merged): a row for each item key with
    its model, occurrences, tokens and first item, and one each for the lines that are requests and that are skipped. Lines
    are parsed once. Numbers of lines must differ between the logs that are added up."""
    own = requests.items(parsed(lines, ignore), outer=True)
    found = _keyed(own, rules)
    kind = F.when(F.col("seq.pos").isNull(), "skipped").otherwise("item")
    one = found.select(kind.alias("kind"), "model", "key", "est_tokens", F.struct("seq", "est_tokens", "preview").alias("first"), F.coalesce(F.col("seq.pos") == 0, F.lit(False)).alias("begins"))
    return _added(one.select(F.when(F.col("kind") == "item", F.struct("model", "key")).alias("id"), F.lit(1).cast("long").alias("n"), F.col("est_tokens").alias("tokens"), "first", F.col("begins").cast("long").alias("requests")))


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.min("first").alias("first"), F.sum("requests").alias("requests"))


def merged(*states: DataFrame) -> DataFrame:
    """The state of all logs together, in whatever order they are added."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return _added(whole)


def _by_key(whole: DataFrame) -> DataFrame:
    """A state's item keys as ledger.by_key gives them."""
    first = {"first_seq": F.col("first.seq"), "first_tokens": F.col("first.est_tokens"), "preview": F.col("first.preview")}
    return whole.where("id IS NOT NULL").select("id.model", "id.key", "n", "tokens", *[c.alias(k) for k, c in first.items()])


def summary(whole: DataFrame, prices: dict[str, float] | None = None) -> DataFrame:
    """One row: requests and skipped lines, items, duplicates, tokens and money over all models, in one pass over a state."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    item = F.col("id").isNotNull()
    own = lambda c: F.when(item, c)
    per = whole.groupBy(F.col("id.model").alias("model")).agg(
        total("requests").alias("requests"), total(F.when(~item, F.col("n"))).alias("skipped"), total(own(F.col("n"))).alias("items"), F.count(own(F.lit(1))).alias("unique_items"), total(own(F.col("n") - 1)).alias("dup_items"),
        total(own(F.col("tokens"))).alias("total_tokens"), total(own(F.col("tokens") - F.col("first.est_tokens"))).alias("wasted_tokens"),
    )
    usd = lambda c: F.coalesce(F.sum(cost(F.col("model"), F.col(c), prices)), F.lit(0.0))
    counts = ("requests", "skipped", "items", "unique_items", "dup_items", "total_tokens", "wasted_tokens")
    rows = per.agg(*[total(c).alias(c) for c in counts], usd("total_tokens").alias("total_usd"), usd("wasted_tokens").alias("wasted_usd"))
    return rows.withColumn("dup_rate", F.when(F.col("items") > 0, F.col("dup_items") / F.col("items")).otherwise(0.0))


def by_model(whole: DataFrame, prices: dict[str, float] | None = None) -> DataFrame:
    """Totals by model of a state."""
    return ledger.model_totals(_by_key(whole), prices)


def top(whole: DataFrame, n: int = 10) -> DataFrame:
    """The keys of a state that waste most tokens, with the preview of their first item."""
    rows = _by_key(whole).where("n >= 2").withColumn("wasted_tokens", (F.col("n") - 1) * F.col("first_tokens")).orderBy(F.desc("wasted_tokens"), "key").limit(n)
    return rows.select("key", "model", F.col("n").alias("occurrences"), "first_tokens", "wasted_tokens", "preview")


def analyze(lines: DataFrame, rules: str = "", prices: dict[str, float] | None = None, n: int = 10, ignore: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of log lines (seq, value): the summary, the totals by model and the top duplicates. The lines are parsed once, into a state
    that is stored."""
    whole = stored(state(lines, rules, ignore), "analysis")
    return summary(whole, prices), by_model(whole, prices), top(whole, n)


class Analysis:
    """An analysis that is kept at a path and grows by logs: each is parsed once and added as a delta of its keys. Logs are
    known by a name, so one that is added again changes nothing. `seq` of a log's lines counts after those of the logs added
    before it, in order of `place`, which may be any order of the logs."""

    def __init__(self, spark: SparkSession, path: str, rules: str = "", ignore: tuple[str, ...] = ()) -> None:
        self.table, self.rules, self.ignore = DeltaTable(spark, path, "id"), rules, ignore

    def add(self, lines: DataFrame, name: str, place: int) -> bool:
        """Adds a log's lines (seq, value); says whether it was new."""
        placed = lines.withColumn("seq", F.struct(F.lit(place).cast("long").alias("place"), F.col("seq").alias("line")))
        done = self.table.commit(state(placed, self.rules, self.ignore), 0, name)
        self.table.compact(_added)
        return done

    def state(self) -> DataFrame:
        return _added(self.table.read())


def render(summary_: DataFrame, top_: DataFrame, by_model: DataFrame | None = None) -> str:
    """The text report of an analysis."""
    s = summary_.first()
    lines = [
        f"requests          {s.requests}" + (f" (and {s.skipped} lines that are none)" if s.skipped else ""),
        f"items             {s['items']}",
        f"  unique          {s.unique_items}",
        f"  duplicate       {s.dup_items} ({100 * s.dup_rate:.1f} %)",
        f"tokens            {s.total_tokens} (${s.total_usd:.4f})",
        f"  on duplicates   {s.wasted_tokens} (${s.wasted_usd:.4f})",
    ]
    lines += [f"{r.occurrences:>6} x {r.first_tokens:>6} tokens  {r.model}  {r.preview}" for r in top_.collect()]
    lines += [f"{r.model}: {r['items']} items, {r.dup_items} duplicate, ${r.wasted_usd:.4f}" for r in (by_model.orderBy("model").collect() if by_model is not None else [])]
    return "\n".join(lines) + "\n"


def as_json(summary_: DataFrame, by_model: DataFrame, top_: DataFrame) -> DataFrame:
    """The whole analysis as one JSON object: totals, models by name, top duplicates in order."""
    models = by_model.agg(F.array_sort(F.collect_list(F.struct("model", *[c for c in by_model.columns if c != "model"]))).alias("models"))
    best = top_.agg(F.array_sort(F.collect_list(F.struct((-F.col("wasted_tokens")).alias("_by"), *top_.columns))).alias("t")).select(F.transform("t", lambda x: x.dropFields("_by")).alias("top_duplicates"))
    whole = summary_.join(F.broadcast(models), F.lit(True)).join(F.broadcast(best), F.lit(True))
    return whole.select(F.to_json(F.struct(*summary_.columns, "models", "top_duplicates")).alias("value"))
