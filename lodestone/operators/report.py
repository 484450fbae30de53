"""The live report: counters of requests joined with the ledger, the cache and shadow samples; as rows, samples and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.functions.cost import cost, percent
from lodestone.operators import lookup, similar


def counters(requests: DataFrame) -> DataFrame:
    """One row over requests (kind: embedding or passthrough, status, retries, fast_failed, over_budget, calls, sent). Requests
    that were refused or failed are counted as such and not among the requests; sent is the items that went upstream."""
    embedding = F.col("kind") == "embedding"
    total = lambda c: F.coalesce(F.sum(F.when(embedding, F.col(c))), F.lit(0)).cast("long")
    return requests.agg(
        F.count_if(embedding & (F.col("status") < 400)).alias("requests"),
        F.count_if(F.col("kind") == "passthrough").alias("passthrough"),
        F.count_if(embedding & ((F.col("status") >= 500) | F.col("status").isNull())).alias("errors"),
        total("calls").alias("upstream_calls"),
        total("sent").alias("upstream_items"),
        total("retries").alias("retries"),
        F.count_if(embedding & F.col("fast_failed")).alias("fast_fails"),
        F.count_if(embedding & F.col("over_budget")).alias("budget_rejects"),
    )


def measures(prices: dict[str, float] | None = None) -> list[Column]:
    """What the report takes from a ledger, as aggregates over all its rows: for agg, and for metrics that are gathered while the
    ledger goes elsewhere."""
    is_ = lambda name: F.col("outcome") == name
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    tokens = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    usd = lambda c: F.coalesce(F.sum(cost(F.col("model"), F.col(c), prices)), F.lit(0.0))
    return [
        F.count(F.lit(1)).alias("items"), count(is_("hit") | is_("semantic")).alias("hits"), count(is_("miss")).alias("misses"), count(is_("coalesced")).alias("coalesced"), count(is_("semantic")).alias("semantic_hits"),
        tokens("saved").alias("saved_tokens"), tokens("spent").alias("spent_tokens"), usd("saved").alias("saved_usd"), usd("spent").alias("spent_usd"),
    ]


def _usage(measured: DataFrame) -> DataFrame:
    """Measures with the rates that follow from them."""
    c = F.col
    return measured.withColumns(
        {
            "hit_rate": F.when(c("items") > 0, (c("hits") + c("coalesced")) / c("items")).otherwise(0.0),
            "duplicate_share": percent(c("saved_tokens"), c("saved_tokens") + c("spent_tokens")) / 100.0,
        }
    )


def gathered(ledger: DataFrame, prices: dict[str, float] | None = None, name: str = "ledger") -> tuple[DataFrame, Observation]:
    """The ledger as it is, and an observation of its measures, which is there once the ledger has been written or read to the end."""
    seen = Observation(name)
    return ledger.observe(seen, *measures(prices)), seen


def full(requests: DataFrame, ledger: DataFrame | Observation, cache: DataFrame, observed: DataFrame | None = None, breaker_open: bool = False, prices: dict[str, float] | None = None) -> DataFrame:
    """One row: counters, outcomes, hit rate, tokens and money, cache size and shadow samples. Requests, ledger and cache are read
    once each; for a ledger that was gathered, its observation takes its place and it is not read at all."""
    if isinstance(ledger, Observation):
        measured = requests.sparkSession.createDataFrame([ledger.get], "items long, hits long, misses long, coalesced long, semantic_hits long, saved_tokens long, spent_tokens long, saved_usd double, spent_usd double")
    else:
        measured = ledger.agg(*measures(prices))
    size = lookup.cache_size(cache).select(F.col("entries").alias("cache_entries"), F.col("bytes").alias("cache_bytes"))
    rows = counters(requests).withColumn("breaker_open", F.lit(int(breaker_open)).cast("long"))
    for more in (_usage(measured), size):
        rows = rows.join(F.broadcast(more), F.lit(True))  # a row each
    if observed is None:
        return rows.withColumns({"shadow_samples": F.lit(0).cast("long"), "shadow_mean_cosine": F.lit(0.0), "shadow_min_cosine": F.lit(0.0)})
    shadow = similar.shadow_summary(observed).select(F.col("n").alias("shadow_samples"), F.coalesce("mean_cosine", F.lit(0.0)).alias("shadow_mean_cosine"), F.coalesce("min_cosine", F.lit(0.0)).alias("shadow_min_cosine"))
    return rows.join(F.broadcast(shadow), F.lit(True))


#: Samples of the exposition: name, type, label of the result, column.
SAMPLES = (
    ("requests_total", "counter", "", "requests"),
    ("passthrough_requests_total", "counter", "", "passthrough"),
    ("errors_total", "counter", "", "errors"),
    ("items_total", "counter", "hit", "hits"),
    ("items_total", "counter", "miss", "misses"),
    ("items_total", "counter", "coalesced", "coalesced"),
    ("upstream_calls_total", "counter", "", "upstream_calls"),
    ("upstream_retries_total", "counter", "", "retries"),
    ("breaker_fast_fails_total", "counter", "", "fast_fails"),
    ("budget_rejects_total", "counter", "", "budget_rejects"),
    ("breaker_open", "gauge", "", "breaker_open"),
    ("upstream_items_total", "counter", "", "upstream_items"),
    ("saved_tokens_total", "counter", "", "saved_tokens"),
    ("spent_tokens_total", "counter", "", "spent_tokens"),
    ("saved_usd", "gauge", "", "saved_usd"),
    ("cache_entries", "gauge", "", "cache_entries"),
    ("cache_bytes", "gauge", "", "cache_bytes"),
)


def samples(report: DataFrame, prefix: str = "engine") -> DataFrame:
    """(metric, type, label, value) of a full report, a sample in each row; ledger.render_prometheus writes them out."""
    one = lambda name, kind, label, c: F.struct(F.lit(f"{prefix}_{name}").alias("metric"), F.lit(kind).alias("type"), F.lit(label).alias("label"), F.col(c).cast("double").alias("value"))
    return report.select(F.inline(F.array(*[one(*s) for s in SAMPLES])))


def lines(report: DataFrame) -> DataFrame:
    """(at, line) of the report as text; what did not happen has no line."""
    c = F.col
    money = lambda tokens, usd: F.format_string("%d ($%.4f)", c(tokens), c(usd))
    row = lambda label, value: F.concat(F.rpad(F.lit(label), 22, " "), value)
    made: list[Column] = [
        row("requests", F.format_string("%d (%d passed through, %d failed)", c("requests"), c("passthrough"), c("errors"))),
        row("items", c("items").cast("string")),
        row("  from the cache", c("hits").cast("string")),
        row("  shared in flight", c("coalesced").cast("string")),
        row("  sent upstream", F.format_string("%d (%d calls, %d retries)", c("misses"), c("upstream_calls"), c("retries"))),
        F.when((c("fast_fails") > 0) | (c("breaker_open") > 0), row("circuit breaker", F.format_string("%s (%d failed fast)", F.when(c("breaker_open") > 0, "open").otherwise("closed"), c("fast_fails")))),
        F.when(c("budget_rejects") > 0, row("over budget", c("budget_rejects").cast("string"))),
        F.when(c("semantic_hits") > 0, row("  near duplicates", c("semantic_hits").cast("string"))),
        F.when(c("shadow_samples") > 0, row("shadow", F.format_string("%d neighbours, cosine %.4f on average, %.4f at least", c("shadow_samples"), c("shadow_mean_cosine"), c("shadow_min_cosine")))),
        row("hit rate", F.format_string("%.1f %%", c("hit_rate") * 100)),
        row("tokens spent", money("spent_tokens", "spent_usd")),
        row("tokens saved", money("saved_tokens", "saved_usd")),
        F.when(c("saved_tokens") + c("spent_tokens") > 0, row("duplicate share", F.format_string("%.1f %%", c("duplicate_share") * 100))),
        row("cache", F.format_string("%d entries, %.1f MB", c("cache_entries"), c("cache_bytes") / 1e6)),
    ]
    return report.select(F.posexplode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("at", "line"))


def render(report: DataFrame, by_model: DataFrame | None = None, budgets: DataFrame | None = None) -> str:
    """The text of a live report, with a line for each model and each budget (caller, spent, token_limit, remaining, resets_in)."""
    out = [r.line for r in lines(report).orderBy("at").collect()]
    for b in budgets.orderBy("caller").collect() if budgets is not None else []:
        out.append(f"  {b.caller}  {b.spent} spent, unlimited" if b.remaining < 0 else f"  {b.caller}  {b.spent} of {b.token_limit} spent, resets in {b.resets_in} s")
    for m in by_model.orderBy("model").collect() if by_model is not None else []:
        out.append(f"  {m.model:<30} {m['items']} items, {m.hits} hits, {m.saved_tokens} tokens saved")
    return "\n".join(out) + "\n"


def throughput(rows: DataFrame, at: str, by: str | None = None) -> DataFrame:
    """Rows, the seconds between the first and the last (column `at`, in seconds), and rows a second; null within one instant."""
    kept = rows.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), (F.max(at) - F.min(at)).alias("seconds"))
    return kept.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")))


def backend_calls(calls: DataFrame, seed: str = "seed") -> DataFrame:
    """How often the backend computed each input; more than once means work that a cache should have spared."""
    return calls.groupBy(seed).agg(F.count("*").alias("n"))
