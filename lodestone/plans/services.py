"""Queries over caches, reference files, workloads and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import cost, sql, text, vectors
from lodestone.operators import budget, chunking, ledger, lookup, mock, replay, report, retrieval, similar
from lodestone.plans.registry import _DOCS, _EVENTS, _KEY, _RANKED, _TOKENS, _USD, DAY, _filled, query
from lodestone.sources import files, tables
from lodestone.streaming import live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.keyed(tables.event_items(spark, sf_dir))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("t", budget.micros(F.col("ts")) / 1e6)


def _entries(items: DataFrame, keep: str = "seq % 7 = 0") -> DataFrame:
    """A cache of some items' keys; entries of every third first item never expire."""
    first = items.where(keep).groupBy("key").agg(F.min("seq").alias("s"), F.max("est_tokens").alias("tokens"))
    return first.select("key", F.encode("key", "utf-8").alias("raw"), "tokens", F.when(F.col("s") % 3 == 0, 0).otherwise(F.col("s") * 10).cast("long").alias("expires_at"))


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{live.shared_dir(spark)}/{label}-{live.unique()}"


_ENTRIES = "c AS (SELECT key, min(seq) AS s, max(tok) AS tokens, CASE WHEN min(seq) % 3 = 0 THEN 0 ELSE min(seq) * 10 END AS expires_at FROM items WHERE seq % 7 = 0 GROUP BY key)"

# --- caches -------------------------------------------------------------------------------------------------


@query(f"WITH {_EVENTS}, {_ENTRIES} SELECT seq, coalesce(expires_at = 0 OR 5000 <= expires_at, false) AS hit FROM items LEFT JOIN c USING (key)")
def cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _events(spark, sf_dir)
    return lookup.probe(items, _entries(items), F.lit(5000)).select("seq", "hit")


@query(f"WITH {_EVENTS}, {_ENTRIES} SELECT count(*) AS entries, CAST(sum(strlen(key)) AS BIGINT) AS bytes FROM c")
def cache_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.cache_size(_entries(_events(spark, sf_dir)))


@query(f"WITH {_EVENTS} SELECT DISTINCT key FROM items WHERE seq % 3 = 1 AND key NOT IN (SELECT key FROM items WHERE seq % 7 = 0) AND key IN (SELECT key FROM items WHERE seq % 2 = 0)")
def warmed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _events(spark, sf_dir)
    return lookup.to_warm(items.where("seq % 3 = 1"), _entries(items), _entries(items, "seq % 2 = 0")).select("key")


@query(f"WITH {_EVENTS} SELECT DISTINCT key, key NOT IN (SELECT key FROM items WHERE seq % 7 = 0) AS owned FROM items WHERE seq % 3 = 1")
def claimed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _events(spark, sf_dir)
    return lookup.claim(items.where("seq % 3 = 1").select("key").distinct(), _entries(items))


@query(f"WITH {_EVENTS}, {_ENTRIES} SELECT count(*) AS compared, count(*) FILTER (WHERE s % 5 = 0) AS mismatches FROM c")
def byte_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(_events(spark, sf_dir))
    other = _events(spark, sf_dir).where("seq % 7 = 0").groupBy("key").agg(F.min("seq").alias("s")).select("key", F.when(F.col("s") % 5 == 0, F.encode(F.lit("x"), "utf-8")).otherwise(F.encode("key", "utf-8")).alias("raw"))
    return lookup.compare_bytes(entries, other, ["key"], "raw")


@query(f"WITH {_EVENTS}, {_ENTRIES} SELECT key, key AS raw, CAST(tokens AS BIGINT) AS tokens, CAST(expires_at AS BIGINT) AS expires_at FROM c")
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, read, written over what it was read from, and read again."""
    path = _scratch(spark, "snapshot")
    if files.read_snapshot(spark, path).count():
        raise ValueError("a snapshot that is not there is empty")
    files.write_snapshot(_entries(_events(spark, sf_dir)), path)
    files.write_snapshot(files.read_snapshot(spark, path), path)
    return files.read_snapshot(spark, path).withColumn("raw", F.decode("raw", "utf-8"))


@query(f"WITH {_EVENTS} SELECT key, count(*) AS n FROM (SELECT DISTINCT key FROM items) GROUP BY key")
def write_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drains of one stream into a shared tier: every key is there once."""
    path = _scratch(spark, "tier")
    for _ in range(2):
        stream = live.table_stream(spark, f"{sf_dir}/events.parquet").select(F.col("event_type").alias("model"), F.col("props").alias("text"))
        live.append_new(ledger.keyed(stream).select("key", "model"), path, _scratch(spark, "checkpoint")).awaitTermination()
    return live.tier(spark, path).groupBy("key").agg(F.count("*").alias("n"))


@query(f"""WITH {_EVENTS}, f AS (SELECT *, CAST((SELECT count(*) FROM range(500, 1000000000, 1000) r(x) WHERE x < seq AND x < 100000) AS INTEGER) AS epoch FROM items) SELECT seq, epoch, row_number() OVER (PARTITION BY epoch, key ORDER BY seq) > 1 AS hit FROM f""".replace("(SELECT count(*) FROM range(500, 1000000000, 1000) r(x) WHERE x < seq AND x < 100000)", "greatest(0, least((seq - 501 + 1000) // 1000, 100))"))
def flush_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred flushes, at 500, 1500 and so on: a key is cached within its epoch only."""
    flushes = spark.range(100).select((F.col("id") * 1000 + 500).alias("seq"))
    rows = replay.flushed(_events(spark, sf_dir), flushes)
    first = rows.groupBy("epoch", "key").agg(F.min("seq").alias("first"))
    return rows.join(first, ["epoch", "key"]).select("seq", "epoch", (F.col("seq") > F.col("first")).alias("hit"))


@query(f"WITH {_EVENTS} SELECT key, max(tok) AS tokens FROM items GROUP BY key")
def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drains of one stream, each leaving a snapshot: every key is there once."""
    path = _scratch(spark, "ticks")
    for _ in range(2):
        stream = live.table_stream(spark, f"{sf_dir}/events.parquet").select(F.col("event_type").alias("model"), F.col("props").alias("text"))
        entries = ledger.keyed(stream).select("key", F.encode("key", "utf-8").alias("raw"), F.col("est_tokens").alias("tokens"), F.lit(0).cast("long").alias("expires_at"))
        live.snapshots(entries, path, _scratch(spark, "checkpoint")).awaitTermination()
    return live.tier(spark, path).select("key", "tokens")


# --- reference files ----------------------------------------------------------------------------------------


def _written(spark: SparkSession, label: str, lines: DataFrame) -> str:
    path = _scratch(spark, label)
    lines.select("value").coalesce(1).write.text(path)
    return path


def _object(rows: DataFrame, name: str, number: str, default: float) -> DataFrame:
    """A few names and numbers as one JSON object, with a default among them."""
    entries = F.map_from_entries(F.collect_list(F.struct(name, F.col(number).cast("string"))))
    body = F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", ")
    return rows.agg(F.concat(F.lit('{"DEFAULT": ' + str(default) + ", "), body, F.lit("}")).alias("value"))


@query("SELECT event_type AS model, count(*) / 8.0::DOUBLE AS price FROM events GROUP BY event_type UNION ALL SELECT 'default', 9.5::DOUBLE")
def price_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by the number of events, written as a file and read again."""
    prices = tables.table(spark, sf_dir, "events").groupBy("event_type").agg((F.count("*") / 8.0).alias("price"))
    rows, default = files.read_prices(spark, _written(spark, "prices", _object(prices, "event_type", "price", 9.5)))
    return rows.unionByName(spark.createDataFrame([("default", default)], "model string, price double"))


@query("SELECT 'k' || user_id % 50 AS caller, CAST(sum(strlen(props)) AS BIGINT) AS token_limit FROM events GROUP BY ALL UNION ALL SELECT 'default', 7")
def budget_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of fifty callers, written as a file and read again."""
    callers = tables.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("k"), (F.col("user_id") % 50).cast("string")).alias("caller")).agg(F.sum(F.octet_length("props")).alias("token_limit"))
    rows, default = files.read_budgets(spark, _written(spark, "budgets", _object(callers, "caller", "token_limit", 7)))
    return rows.unionByName(spark.createDataFrame([("default", default)], "caller string, token_limit long"))


@query("SELECT DISTINCT 'file' AS origin, 'key-' || user_id AS key FROM events WHERE user_id % 3 <> 0 UNION ALL SELECT DISTINCT 'list', event_type FROM events")
def key_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key for each user on a line of its own, every third one commented out, and a list of the kinds of events."""
    events = tables.table(spark, sf_dir, "events")
    key = F.concat(F.lit("key-"), F.col("user_id").cast("string"))
    lines = events.select("user_id").distinct().select(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("#"), key)).when(F.col("user_id") % 3 == 1, F.concat(F.lit("\t "), key, F.lit("  "))).otherwise(key).alias("value"))
    path = _written(spark, "keys", lines.unionByName(spark.createDataFrame([("# comment",), ("",), ("  ",)], "value string")))
    kinds = ", ,".join(r.event_type for r in events.select("event_type").distinct().collect())  # a few names
    rows = files.read_keys(spark, path).select(F.lit("file").alias("origin"), "key")
    return rows.unionByName(files.keys_from_list(spark, f" {kinds},").select(F.lit("list").alias("origin"), "key"))


@query("""WITH c AS (SELECT doc_id, trim(coalesce(source, '') || '. ' || replace(text, chr(10), ' ')) AS t FROM documents), q AS (SELECT item_id, replace(text, chr(10), ' ') AS t FROM benchmark)
SELECT 'corpus' AS kind, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM c UNION ALL SELECT 'first ten', 10, CAST(sum(length(t)) AS BIGINT) FROM (SELECT t FROM c ORDER BY CAST(doc_id AS VARCHAR) LIMIT 10)
UNION ALL SELECT 'queries', count(*), CAST(sum(length(t)) AS BIGINT) FROM q UNION ALL SELECT 'qrels', count(*), CAST(sum(quality) AS BIGINT) FROM labels WHERE quality IS NOT NULL""")
def collection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retrieval collection written as its files and read again."""
    base = _scratch(spark, "collection")
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    tables.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.coalesce("source", F.lit("")).alias("title"), flat("text").alias("text")).write.json(f"{base}/corpus")
    tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("_id"), flat("text").alias("text")).write.json(f"{base}/queries")
    qrels = tables.table(spark, sf_dir, "labels").where("quality IS NOT NULL").select((F.col("doc_id") % 7).alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("quality").alias("score"))
    qrels.write.option("sep", "\t").option("header", True).csv(f"{base}/qrels")
    size = lambda kind, df, c: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(c).cast("long").alias("chars"))
    corpus, first = files.read_corpus(spark, f"{base}/corpus"), files.read_corpus(spark, f"{base}/corpus", most=10)
    parts = [size("corpus", corpus, F.length("text")), size("first ten", first, F.length("text")), size("queries", files.read_queries(spark, f"{base}/queries"), F.length("text")), size("qrels", files.read_qrels(spark, f"{base}/qrels"), "relevance")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {_EVENTS} SELECT seq, tok * CASE model WHEN 'click' THEN 0.5::DOUBLE WHEN 'view' THEN 1.25::DOUBLE ELSE 0.02::DOUBLE END / 1e6::DOUBLE AS usd FROM items")
def cost_by_price_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 0.5), ("view", 1.25), ("other", 3.0)], "model string, price double")
    return cost.with_cost(_events(spark, sf_dir), prices, "model", "est_tokens").select("seq", "usd")


# --- usage and reports --------------------------------------------------------------------------------------

_TRAFFIC = "t AS (SELECT event_id AS seq, event_type, user_id, CASE WHEN event_type = 'signup' THEN 'passthrough' ELSE 'embedding' END AS kind, event_type = 'error' AND user_id % 2 = 0 AS fast, event_type = 'purchase' AND user_id % 10 = 0 AS over FROM events), u AS (SELECT *, CASE WHEN over THEN 429 WHEN event_type = 'error' THEN 502 ELSE 200 END AS status, CASE WHEN event_type = 'error' AND NOT fast THEN user_id % 3 ELSE 0 END AS retries, CASE WHEN fast OR over THEN 0 WHEN event_type = 'error' THEN 1 + user_id % 3 ELSE 1 END AS calls, CASE WHEN fast OR over THEN 0 ELSE user_id % 4 END AS sent FROM t)"


def _traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, error = F.col("user_id"), F.col("event_type") == "error"
    rows = tables.table(spark, sf_dir, "events").select("event_type", "user_id", F.when(F.col("event_type") == "signup", "passthrough").otherwise("embedding").alias("kind"), (error & (user % 2 == 0)).alias("fast_failed"), ((F.col("event_type") == "purchase") & (user % 10 == 0)).alias("over_budget"))
    none = F.col("fast_failed") | F.col("over_budget")
    return rows.withColumns({"status": F.when(F.col("over_budget"), 429).when(error, 502).otherwise(200), "retries": F.when(error & ~F.col("fast_failed"), user % 3).otherwise(0), "calls": F.when(none, 0).when(error, 1 + user % 3).otherwise(1), "sent": F.when(none, 0).otherwise(user % 4)})


_COUNTERS = """SELECT count(*) FILTER (WHERE kind = 'embedding' AND status < 400) AS requests, count(*) FILTER (WHERE kind = 'passthrough') AS passthrough, count(*) FILTER (WHERE kind = 'embedding' AND status >= 500) AS errors,
CAST(sum(calls) FILTER (WHERE kind = 'embedding') AS BIGINT) AS upstream_calls, CAST(sum(sent) FILTER (WHERE kind = 'embedding') AS BIGINT) AS upstream_items, CAST(sum(retries) FILTER (WHERE kind = 'embedding') AS BIGINT) AS retries,
count(*) FILTER (WHERE fast) AS fast_fails, count(*) FILTER (WHERE over) AS budget_rejects FROM u"""


@query(f"WITH {_TRAFFIC} {_COUNTERS}")
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counters(_traffic(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that were computed, shared in flight or found; what is shared or found saves its tokens."""
    rows = lookup.coalesced_within(_timed(spark, sf_dir), 3600.0)
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "hit") & (F.col("seq") % 10 == 0), "semantic").otherwise(F.col("outcome")))
    miss = F.col("outcome") == "miss"
    return rows.withColumns({"spent": F.when(miss, F.col("est_tokens")).otherwise(0), "saved": F.when(miss, 0).otherwise(F.col("est_tokens"))})


_MIXED = f"""{_EVENTS}, f AS (SELECT key, min_by(epoch_us(ts) / 1e6, (ts, seq)) AS t0, min_by(seq, (ts, seq)) AS owner FROM items GROUP BY key),
o AS (SELECT *, CASE WHEN seq = owner THEN 'miss' WHEN epoch_us(ts) / 1e6 <= t0 + 3600 THEN 'coalesced' WHEN seq % 10 = 0 THEN 'semantic' ELSE 'hit' END AS outcome FROM items JOIN f USING (key)),
l AS (SELECT *, CASE WHEN outcome = 'miss' THEN tok ELSE 0 END AS spent, CASE WHEN outcome = 'miss' THEN 0 ELSE tok END AS saved FROM o)"""
_MIXED_USAGE = "count(*) AS items, count(*) FILTER (WHERE outcome <> 'miss') AS hits, count(*) FILTER (WHERE outcome = 'miss') AS misses, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(spent) AS BIGINT) AS spent_tokens"


@query(f"WITH {_MIXED} SELECT caller, {_MIXED_USAGE} FROM l GROUP BY caller")
def mixed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.usage(_mixed(spark, sf_dir), "caller")


@query(f"WITH {_MIXED}, b AS (SELECT caller FROM items GROUP BY caller ORDER BY min(seq) LIMIT 40) SELECT caller, {_MIXED_USAGE} FROM l WHERE caller IN (SELECT caller FROM b) GROUP BY caller")
def first_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by the first forty callers: the bound on buckets is the feature."""
    return ledger.usage(ledger.first_buckets(_mixed(spark, sf_dir), "caller", 40), "caller")


_FULL = f"""{_TRAFFIC}, {_MIXED}, n AS ({_COUNTERS}), g AS (SELECT count(*) AS items, count(*) FILTER (WHERE outcome IN ('hit', 'semantic')) AS hits, count(*) FILTER (WHERE outcome = 'miss') AS misses, count(*) FILTER (WHERE outcome = 'coalesced') AS coalesced,
count(*) FILTER (WHERE outcome = 'semantic') AS semantic_hits, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(spent) AS BIGINT) AS spent_tokens, sum(saved) * 0.02::DOUBLE / 1e6 AS saved_usd, sum(spent) * 0.02::DOUBLE / 1e6 AS spent_usd FROM l),
z AS (SELECT count(*) AS cache_entries, CAST(sum(strlen(key)) AS BIGINT) AS cache_bytes FROM (SELECT DISTINCT key FROM items WHERE seq % 7 = 0)), w AS (SELECT * FROM n, g, z)"""


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.full(_traffic(spark, sf_dir), _mixed(spark, sf_dir), _entries(_events(spark, sf_dir)), breaker_open=True)


def _sql_samples() -> str:
    own = {"breaker_open": "1.0::DOUBLE", "saved_usd": "round(saved_usd, 9)"}
    return " UNION ALL ".join(f"SELECT 'engine_{n}' AS metric, '{k}' AS type, '{r}' AS label, CAST({own.get(c, c)} AS DOUBLE) AS value FROM w" for n, k, r, c in report.SAMPLES)


@query(f"WITH {_FULL} {_sql_samples()}")
def prometheus_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.samples(_full(spark, sf_dir))
    return rows.withColumn("value", F.when(F.col("metric") == "engine_saved_usd", F.round("value", 9)).otherwise(F.col("value")))


@query(f"""WITH {_FULL} SELECT CAST(unnest(range(0, 13)) AS INTEGER) AS at, unnest([rpad('requests', 22, ' ') || printf('%d (%d passed through, %d failed)', requests, passthrough, errors), rpad('items', 22, ' ') || items, rpad('  from the cache', 22, ' ') || hits,
rpad('  shared in flight', 22, ' ') || coalesced, rpad('  sent upstream', 22, ' ') || printf('%d (%d calls, %d retries)', misses, upstream_calls, retries), rpad('circuit breaker', 22, ' ') || printf('open (%d failed fast)', fast_fails), rpad('over budget', 22, ' ') || budget_rejects,
rpad('  near duplicates', 22, ' ') || semantic_hits, rpad('hit rate', 22, ' ') || printf('%.1f %%', (hits + coalesced) / items * 100), rpad('tokens spent', 22, ' ') || printf('%d ($%.4f)', spent_tokens, spent_usd), rpad('tokens saved', 22, ' ') || printf('%d ($%.4f)', saved_tokens, saved_usd),
rpad('duplicate share', 22, ' ') || printf('%.1f %%', saved_tokens / (saved_tokens + spent_tokens) * 100),
rpad('cache', 22, ' ') || printf('%d entries, %.1f MB', cache_entries, cache_bytes / 1e6)]) AS line FROM w""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.lines(_full(spark, sf_dir))


@query(f"WITH {_EVENTS} SELECT left(sha256(caller), 8) AS caller, sum(tok)::BIGINT AS spent, CAST(43200 AS BIGINT) AS resets_in FROM items GROUP BY items.caller")
def budget_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = _events(spark, sf_dir).groupBy("caller").agg(F.sum("est_tokens").alias("spent"))
    shown = budget.display(spent, DAY, F.lit("2024-01-01 12:00:00").cast("timestamp_ntz"))
    return shown.select("caller", "spent", F.col("resets_in").cast("long").alias("resets_in"))


@query(f"WITH {_EVENTS}, g AS (SELECT model, count(*) AS n, max(epoch_us(ts)) / 1e6 - min(epoch_us(ts)) / 1e6 AS seconds FROM items GROUP BY model) SELECT model, n, round(n / seconds, 9) AS per_second FROM g")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.throughput(_timed(spark, sf_dir), "t", "model").select("model", "n", F.round("per_second", 9).alias("per_second"))


@query(f"WITH {_EVENTS} SELECT text AS seed, count(*) AS n FROM items GROUP BY text")
def backend_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.backend_calls(_events(spark, sf_dir).withColumn("seed", F.col("text")))


# --- scalar rules -------------------------------------------------------------------------------------------


@query("SELECT event_id, event_id % 9 + 1 AS attempt, CASE WHEN event_id % 4 = 0 THEN least(user_id * 1000.0::DOUBLE, 5000.0::DOUBLE) ELSE least(4000.0::DOUBLE, 250.0::DOUBLE * pow(2.0::DOUBLE, event_id % 9)) END AS wait_ms FROM events")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9 + 1).alias("attempt"), F.when(F.col("event_id") % 4 == 0, F.col("user_id").cast("double")).alias("after"))
    return rows.select("event_id", "attempt", cost.backoff_ms(F.col("attempt"), F.col("after")).alias("wait_ms"))


@query(f"SELECT lang, round(100.0::DOUBLE * (sum({_filled(_TOKENS, text='text')}) - sum(len(string_split(text, ' ')))) / sum(len(string_split(text, ' '))), 9) AS drift FROM documents GROUP BY lang")
def estimate_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far estimates lie from counts of words."""
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    sums = docs.groupBy("lang").agg(F.sum(text.estimate_tokens(F.col("text"))).alias("e"), F.sum(F.size(F.split("text", " "))).alias("w"))
    return sums.select("lang", F.round(cost.drift(F.col("e"), F.col("w")), 9).alias("drift"))


_WIDE = "replace(replace(text, 'e', '漢'), 'a', 'あ')"


@query(f"SELECT doc_id, CAST({_filled(_TOKENS, text=_WIDE)} AS BIGINT) AS est_tokens FROM documents")
def token_estimate_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", text.estimate_tokens(F.replace(F.replace("text", F.lit("e"), F.lit("漢")), F.lit("a"), F.lit("あ"))).alias("est_tokens"))


@query("SELECT event_id, 'tokens:[' || user_id || ' ' || (event_id % 7) || ']' AS seed FROM events")
def token_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select("event_id", F.array("user_id", F.col("event_id") % 7).alias("tokens"))
    return rows.select("event_id", mock.token_seed(F.col("tokens")).alias("seed"))


@query("SELECT event_id, 'what is ' || props || '|why ' || event_type || '|' || CASE WHEN user_id % 2 = 0 THEN 'third item' ELSE '1. what is ' || props END AS items FROM events")
def sub_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a numbered list of three lines, or two filled up with the text's first line."""
    body = F.concat(F.lit("1. what is "), "props", F.lit("\n 2)  why "), "event_type", F.when(F.col("user_id") % 2 == 0, "\n3. third item").otherwise(""))
    return tables.table(spark, sf_dir, "events").select("event_id", F.array_join(text.numbered_lines(body, 3), "|").alias("items"))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, 0, 0 FROM embeddings WHERE vec_id % 3 = 0")
def decoded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays are read as vectors; base64 text and empty arrays are none."""
    rows = tables.table(spark, sf_dir, "embeddings").withColumn("raw", F.when(F.col("vec_id") % 3 != 0, F.to_json(F.transform("embedding", lambda x: x.cast("double")))).when(F.col("vec_id") % 2 == 0, F.lit('"AACAPw=="')).otherwise(F.lit("[]")))
    v = vectors.decode_json_vector(F.col("raw"))
    return rows.select("vec_id", F.when(v.isNotNull(), F.size(v)).otherwise(0).cast("long").alias("n"), F.coalesce(F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6), F.lit(0.0)).alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, CAST((len(embedding) * 4 + 2) // 3 * 4 AS BIGINT) AS chars FROM embeddings")
def base64_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "embeddings").select("vec_id", mock.base64_floats("embedding").alias("b"))
    back = mock.floats_of_base64("b")
    return rows.select("vec_id", F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"), F.length("b").cast("long").alias("chars"))


def _sql_all_pairs(c: str) -> str:
    for pair, letter in text.COMPOSED.items():
        c = f"replace({c}, '{letter}', '{pair}')"
    return c


def _sql_letters() -> str:
    return "'" + "".join(text.COMPOSED.values()) + "'"


@query(f"SELECT doc_id, md5({_sql_letters()} || text) AS digest FROM documents")
def nfc_fold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the table, taken apart and composed again."""
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    apart = F.concat(F.lit("".join(text.COMPOSED)), "text")
    return docs.select("doc_id", F.md5(text.fold(apart)).alias("digest"))


# --- replay -------------------------------------------------------------------------------------------------

_VERDICTS = """WITH e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS credential, event_id AS seq, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type = 'error' THEN NULL ELSE event_type <> 'signup' END AS answer FROM events),
s AS (SELECT credential, count(*) AS n, list_reduce(list_prepend({'t': 0::DOUBLE, 'answer': NULL::BOOLEAN, 'kept': NULL::BOOLEAN, 'until': 0::DOUBLE, 'asked': 0::BIGINT, 'allowed': 0::BIGINT}, list({'t': t, 'answer': answer, 'kept': NULL::BOOLEAN, 'until': 0::DOUBLE, 'asked': 0::BIGINT, 'allowed': 0::BIGINT} ORDER BY seq)),
lambda a, x: CASE WHEN a.kept IS NOT NULL AND x.t <= a.until THEN {'t': x.t, 'answer': NULL::BOOLEAN, 'kept': a.kept, 'until': a.until, 'asked': a.asked, 'allowed': a.allowed + CASE WHEN a.kept THEN 1 ELSE 0 END}
WHEN x.answer IS NULL THEN {'t': x.t, 'answer': NULL::BOOLEAN, 'kept': NULL::BOOLEAN, 'until': a.until, 'asked': a.asked + 1, 'allowed': a.allowed}
ELSE {'t': x.t, 'answer': NULL::BOOLEAN, 'kept': x.answer, 'until': x.t + CASE WHEN x.answer THEN 36000 ELSE 6000 END, 'asked': a.asked + 1, 'allowed': a.allowed + CASE WHEN x.answer THEN 1 ELSE 0 END} END) AS r FROM e GROUP BY credential)
SELECT credential, n, r.asked AS asked, r.allowed AS allowed FROM s"""


@query(_VERDICTS)
def verdict_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).select((F.col("caller").cast("long") % 40).cast("string").alias("credential"), "seq", "t", F.when(F.col("model") != "error", F.col("model") != "signup").alias("answer"))
    kept = replay.verdicts(rows, 36_000.0, 6_000.0)
    return kept.groupBy("credential").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.count_if("allowed").alias("allowed"))


_WAIT, _PATIENCE = 7200, 3600
_FLIGHT = "{'t': %s, 'seq': %s, 'fails': %s, 'owner': %s, 'since': %s, 'bad': %s, 'done': %s, 'out': %s}"
_NEW = _FLIGHT % ("{t}", "{seq}", "{fails}", "-1::BIGINT", "0::DOUBLE", "false", "-1::BIGINT", "[]::STRUCT(seq BIGINT, owner BIGINT, outcome VARCHAR)[]")
_STAY = _FLIGHT % ("x.t", "x.seq", "x.fails", "a.owner", "a.since", "a.bad", "a.done", "list_append(a.out, {{'seq': x.seq, 'owner': {owner}, 'outcome': {outcome}}})".replace("{{", "{").replace("}}", "}"))
_TURN = _FLIGHT % ("x.t", "x.seq", "x.fails", "x.seq", "x.t", "x.fails", "CASE WHEN x.fails THEN -1 ELSE x.seq END", "list_append(a.out, {'seq': x.seq, 'owner': x.seq, 'outcome': CASE WHEN x.fails THEN 'failed' ELSE 'miss' END})")


@query(f"""WITH {_EVENTS}, f AS (SELECT key, list_reduce(list_prepend({_filled(_NEW, t='0::DOUBLE', seq='-1::BIGINT', fails='false')}, list({_filled(_NEW, t='epoch_us(ts) / 1e6', seq='seq', fails='seq % 3 <> 0')} ORDER BY ts, seq)),
lambda a, x: CASE WHEN a.owner >= 0 AND x.t <= a.since + {_WAIT} THEN {_filled(_STAY, owner='a.owner', outcome=f"CASE WHEN a.since + {_WAIT} - x.t > {_PATIENCE} THEN 'gave_up' WHEN a.bad THEN 'failed' ELSE 'coalesced' END")}
WHEN a.done >= 0 THEN {_filled(_STAY, owner='a.done', outcome="'hit'")} ELSE {_TURN} END).out AS out FROM items GROUP BY key), o AS (SELECT key, unnest(out) AS o FROM f) SELECT key, o.seq AS seq, o.owner AS owner, o.outcome AS outcome FROM o""")
def coalesce_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three computations fail, and waiters give up after an hour of two."""
    return lookup.coalesced_calls(_timed(spark, sf_dir), float(_WAIT), float(_PATIENCE), F.col("seq") % 3 != 0)


@query("""WITH a AS (SELECT event_id // 5 AS call, event_id % 5 AS attempt, CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 429 WHEN 'view' THEN 404 WHEN 'signup' THEN NULL ELSE 200 END AS status FROM events),
f AS (SELECT call, min(attempt) FILTER (WHERE status IS NOT NULL AND status <> 429 AND status < 500 AND attempt <= 3) AS first, max(attempt) FILTER (WHERE attempt <= 3) AS last FROM a GROUP BY call)
SELECT call, CASE WHEN first IS NULL THEN 'failed' WHEN status >= 400 THEN 'rejected' ELSE 'ok' END AS outcome, coalesce(first, last) AS retries FROM f LEFT JOIN a USING (call) WHERE a.attempt = coalesce(first, last)""")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", 503).when(kind == "click", 429).when(kind == "view", 404).when(kind == "signup", None).otherwise(200)
    calls = tables.table(spark, sf_dir, "events").select(F.expr("event_id div 5").alias("call"), (F.col("event_id") % 5).alias("attempt"), status.alias("status"))
    return replay.retries(calls, 3)


# --- retrieval, chunks, workloads ---------------------------------------------------------------------------

_COS = """v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.id AS qid, c.id, q.label = c.label AS same, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
FROM v q JOIN v c ON q.id % 100 = 0 AND c.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS rank FROM s), i AS (SELECT qid, count(*) AS n FROM s WHERE same GROUP BY qid),
d AS (SELECT qid, sum(CASE WHEN same AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (WHERE same AND rank <= 100) AS found FROM r GROUP BY qid)"""


@query(f"WITH {_COS} SELECT count(*) AS queries, round(avg(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1 / log2(k + 1)))), 9) AS ndcg, round(avg(found / n), 9) AS recall FROM d JOIN i USING (qid) WHERE qid % 300 <> 0")
def evaluate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the judged queries; every third query has no judgements and does not count."""
    v = tables.vectors(spark, sf_dir)
    ranked = retrieval.rank(v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v"), v.select("id", "v"), 100, others=True)
    judged = v.select(F.col("id"), "label").withColumn("judged", F.col("id") % 300 != 0)
    whole = retrieval.evaluate_labelled(ranked, judged)
    return whole.select("queries", F.round("ndcg", 9).alias("ndcg"), F.round("recall", 9).alias("recall"))


@query("SELECT item_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS variant, unnest([text, 'What is ' || text || '?', text || ' explained']) AS variant_text FROM benchmark")
def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.table(spark, sf_dir, "benchmark")
    return retrieval.expand_queries(items, "text", ["What is {}?", "{} explained"]).select("item_id", "variant", "variant_text")


@query("WITH b AS (SELECT *, (row_number() OVER (ORDER BY user_id, event_id) - 1) // 32 AS batch FROM events) SELECT batch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM b GROUP BY batch")
def backend_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of 32 inputs, in order of users."""
    rows = tables.table(spark, sf_dir, "events").select("user_id", "event_id")
    return retrieval.batched(rows, ["user_id", "event_id"], 32).groupBy("batch").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _sql_hash(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 15) AS BIGINT)"


@query(f"SELECT doc_id, {_sql_hash('7', 'doc_id')} % 10000 < 500 AS changed, sha256(text || CASE WHEN {_sql_hash('7', 'doc_id')} % 10000 < 500 THEN ' edited' ELSE '' END) AS hash FROM documents")
def document_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About five in a hundred documents edited, and what of them a cache of the texts before would not find."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    again = mock.edited(docs, "doc_id", "text", 0.05, seed=7).select("doc_id", F.sha2("text", 256).alias("hash"))
    return again.join(docs.select("doc_id", F.sha2("text", 256).alias("old")), "doc_id").select("doc_id", (F.col("hash") != F.col("old")).alias("changed"), "hash")


_AT = f"({_sql_hash('3', 'event_id')} % 10000 / 10000.0::DOUBLE)"


@query(f"""WITH c AS (SELECT event_id, CASE WHEN {_AT} < 0.2::DOUBLE THEN 'bad-' || event_id WHEN {_AT} < 0.2::DOUBLE + 0.05::DOUBLE THEN '' ELSE 'good' END AS credential FROM events)
SELECT credential = 'good' AS good, CASE WHEN credential = '' THEN 'missing' WHEN credential = 'good' THEN 'ok' ELSE 'unknown' END AS verdict, count(*) AS n FROM c GROUP BY ALL""")
def hostile_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of which a fifth has a wrong key and a twentieth none, against an allow list of one."""
    rows = mock.hostile(tables.table(spark, sf_dir, "events").select("event_id"), "event_id", "good", seed=3)
    allow = spark.range(1).select(F.sha2(F.lit("good"), 256).alias("key_hash"))
    bearer = F.when(F.col("key") != "", F.concat(F.lit("Bearer "), "key")).otherwise("")
    met = lookup.allowed(rows.withColumnRenamed("credential", "key").withColumn("credential", bearer), allow)
    return met.groupBy((F.col("key") == "good").alias("good"), "verdict").agg(F.count("*").alias("n"))


@query("SELECT doc_id, p AS part FROM (SELECT doc_id, unnest(list_transform(list_filter(list_transform(string_split(text, '. '), lambda p: trim(p, ' ')), lambda p: strlen(p) >= 80), lambda p: left(p, 1200))) AS p FROM documents)")
def delimited_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.explode(chunking.delimited(F.col("text"), ". ")).alias("part"))


@query("SELECT doc_id, sha256(unhex(substring(h, i * 1600 + 1, 1600))) AS hash, length(substring(h, i * 1600 + 1, 1600)) // 2 AS size FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, (strlen(text) + 799) // 800)) AS i FROM documents)")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as JSON lines, read again; the text of a chunk that is cut within no character hashes to its hash."""
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    chunks = chunking.exploded(docs, chunking.fixed_chunks(F.col("text")), "doc_id")
    lines = chunks.select("doc_id", chunking.line(F.col("hash"), F.col("size"), F.col("data")).alias("value"))
    back = lines.select("doc_id", F.from_json("value", "hash string, size bigint, text string").alias("c")).select("doc_id", "c.*")
    hashed = F.when(F.contains("text", F.lit("�")), F.col("hash")).otherwise(F.sha2("text", 256))
    return back.select("doc_id", hashed.alias("hash"), "size")


@query("SELECT count(*) AS items, count(*) * 5 // 100 AS computed, round((count(*) - count(*) * 5 // 100) / count(*), 9) AS absorbed FROM documents")
def reingest_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read again after an edit of exactly five in a hundred: all others are found."""
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit("m").alias("model"), F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text").alias("text"))
    cache = ledger.keyed(docs).select("key")
    again = ledger.keyed(mock.edited_exactly(docs, "seq", "text", 0.05))
    counts = again.join(cache.withColumn("old", F.lit(True)), "key", "left").agg(F.count("*").alias("items"), F.count_if(F.col("old").isNull()).alias("computed"))
    return counts.select("items", "computed", F.round(1 - F.col("computed") / F.col("items"), 9).alias("absorbed"))


@query(f"WITH {_EVENTS}, w AS (SELECT caller, CAST(floor(epoch_us(ts) / {DAY * 1_000_000}) AS BIGINT) AS win, CAST(sum(tok) AS BIGINT) AS tokens FROM items GROUP BY ALL) SELECT caller, win, tokens FROM w")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = live.table_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("caller"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.col("props").alias("text"))
    rows = live.drained(live.windowed_spending(ledger.keyed(events), "ts", DAY, "1 day"), "complete")
    return rows.select("caller", budget.window_id(F.col("window.start"), DAY).alias("win"), "tokens")


@query(f"WITH {_DOCS} SELECT key AS id, min(seq) AS seq FROM items GROUP BY key ORDER BY min(seq) LIMIT 100")
def indexed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of an index that holds a hundred: the bound is the feature."""
    items = ledger.keyed(tables.document_items(spark, sf_dir)).withColumnRenamed("key", "id")
    return similar.indexed(items, 100).select("id", "seq")


_SMALL_GRAMS = "p AS (SELECT item_id AS id, ' ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || ' ' AS s FROM benchmark), g AS (SELECT DISTINCT id, substring(s, i, 3) AS gram FROM (SELECT id, s, unnest(range(1, length(s) - 1)) AS i FROM p)), z AS (SELECT id, count(*) AS n FROM g GROUP BY id), o AS (SELECT a.id AS q, b.id AS c, count(*) AS o FROM g a JOIN g b USING (gram) WHERE b.id < a.id GROUP BY ALL), j AS (SELECT q, c, o / (x.n + y.n - o) AS similarity FROM o JOIN z x ON q = x.id JOIN z y ON c = y.id), b AS (SELECT * FROM j WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) = 1)"


@query(f"WITH {_SMALL_GRAMS} SELECT q, c, CASE WHEN c % 3 = 0 THEN 'miss' WHEN c % 3 = 1 AND c * 10 < 50 THEN 'miss' ELSE 'semantic' END AS outcome, CASE WHEN c % 3 = 0 OR c % 3 = 1 AND c * 10 < 50 THEN NULL ELSE 'v' || c END AS raw FROM b")
def neighbour_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours whose entries are live are served; those of evicted or expired ones are misses."""
    items = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("seq"), "text")
    found = similar.nearest(similar.pairs(items, 0.2))
    cache = items.where("id % 3 <> 0").select(F.col("id").alias("key"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("raw"), F.when(F.col("id") % 3 == 1, F.col("id") * 10).otherwise(0).alias("expires_at"))
    return lookup.serving(found, cache, F.lit(50)).select("q", "c", "outcome", "raw")


@query(f"WITH {_EVENTS}, {_RANKED} SELECT model, {_filled(_USD, tokens='sum(tok)', model='model')} AS spent_usd FROM ranked WHERE rn = 1 GROUP BY model")
def spent_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.usage(ledger.outcomes(_events(spark, sf_dir)), "model")
    return rows.select("model", cost.cost(F.col("model"), F.col("spent_tokens")).alias("spent_usd"))


def _sql_values(digest: str, part: int) -> str:
    """The eight numbers of a digest (hexadecimal), in single precision, as a list."""
    word = "('0x' || substr(h, 8 * j + 7, 2) || substr(h, 8 * j + 5, 2) || substr(h, 8 * j + 3, 2) || substr(h, 8 * j + 1, 2))::BIGINT"
    return f"list_transform(range(0, 8), lambda j: CAST({word.replace('h,', digest + ',')} AS FLOAT) / 4294967296::FLOAT * 2::FLOAT - 1::FLOAT)"


def sql_vectors(model: str, seed: str, parts: int, table: str, more: str) -> str:
    """WITH parts that give `vectors`: more, v (a list of 8 * parts numbers) of the rows of a table."""
    out = f"h1 AS (SELECT {more}, sha256(encode({model}) || '\\x00'::BLOB || encode({seed})) AS d1 FROM {table})"
    for k in range(2, parts + 1):
        out += f", h{k} AS (SELECT *, sha256(unhex(d{k - 1})) AS d{k} FROM h{k - 1})"
    whole = " || ".join(_sql_values(f"d{k}", k) for k in range(1, parts + 1))
    return out + f", vectors AS (SELECT *, {whole} AS v FROM h{parts})"


@query(f"WITH {sql_vectors("'m'", 'text', 2, 'documents', 'doc_id')} SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, round(CAST(v[i] AS DOUBLE), 7) AS value FROM (SELECT doc_id, v, unnest(range(1, 17)) AS i FROM vectors)")
def mock_vector_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(mock.embed(F.lit("m"), F.col("text"), 16)).alias("place", "x")).select("doc_id", "place", F.round(F.col("x").cast("double"), 7).alias("value"))


@query(f"""WITH {_DOCS}, k AS (SELECT key, min_by(model, seq) AS model, min_by(text, seq) AS text FROM items WHERE key NOT IN (SELECT key FROM items WHERE seq % 2 = 0) GROUP BY key), {sql_vectors('model', 'text', 1, 'k', 'key')}
SELECT key, CAST(i - 1 AS INTEGER) AS place, round(CAST(v[i] AS DOUBLE), 7) AS value FROM (SELECT key, v, unnest(range(1, 9)) AS i FROM vectors)""")
def computed_miss_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = ledger.keyed(tables.document_items(spark, sf_dir))
    made = mock.compute_missing(items, _entries(items, "seq % 2 = 0"), 8)
    return made.select("key", F.posexplode("v").alias("place", "x")).select("key", "place", F.round(F.col("x").cast("double"), 7).alias("value"))


_TRIGRAMS = "list_distinct(list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3)))"


@query(f"""WITH d AS (SELECT doc_id, text, ' ' || trim(regexp_replace(lower(text), '[{text.WHITE}]+', ' ', 'g')) || ' ' AS s FROM documents)
SELECT doc_id, CAST({_filled(_TOKENS, text='text')} AS BIGINT) AS est_tokens, {_filled(_KEY, model="'m'", text='text')} AS key, CAST(CASE WHEN length(s) < 3 THEN 1 ELSE len({_TRIGRAMS}) END AS BIGINT) AS n_trigrams, round(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) + 2.0::DOUBLE) / (sqrt(length(text) * length(text) + 1.0::DOUBLE) * sqrt(5.0::DOUBLE)) END, 9) AS cosine, CAST(strlen(text) AS BIGINT) AS bytes FROM d""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered functions from a SQL text; the sizes of the content-defined chunks sum to the text's."""
    sql.register(spark)
    tables.spread(tables.table(spark, sf_dir, "documents"), task_bytes=8 << 20).createOrReplaceTempView("lodestone_documents")
    return spark.sql("""SELECT doc_id, estimate_tokens(text) AS est_tokens, fingerprint('m', text) AS key, CAST(size(char_trigrams(text)) AS BIGINT) AS n_trigrams,
        round(cosine_similarity(CASE WHEN length(text) > 0 THEN array(CAST(length(text) AS DOUBLE), 1D) END, array(1D, 2D)), 9) AS cosine,
        aggregate(cdc_chunks(text), 0L, (n, c) -> n + c.size) AS bytes FROM lodestone_documents""")
