"""Every registered query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import cost, identity, text, vectors
from lodestone.operators import budget, chunking, heavy, ledger, lookup, mock, replay, retrieval, scan, similar
from lodestone.plans.registry import _COLLAPSE, _CONV, _DOCS, _EVENTS, _KEY, _RANKED, _TOKENS, _USD, DAY, LIMIT, ORACLE, OWN_LIMIT, QUERIES, _filled, query
from lodestone.sources import requests, tables
from lodestone.sources.shared import stored
from lodestone.streaming import live

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.keyed(tables.document_items(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.keyed(tables.event_items(spark, sf_dir))


def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.keyed(tables.conversation_items(spark, sf_dir))


# --- duplicates and identity --------------------------------------------------------------------------------

_SUMMARY = """count(*) AS items, count(*) FILTER (WHERE rn = 1) AS unique_items, count(*) FILTER (WHERE rn > 1) AS dup_items, CAST(sum(tok) AS BIGINT) AS total_tokens,
  CAST(coalesce(sum(tok) FILTER (WHERE rn > 1), 0) AS BIGINT) AS wasted_tokens"""


@query(f"WITH {_DOCS}, {_RANKED} SELECT {_SUMMARY}, count(*) FILTER (WHERE rn > 1) / count(*) AS dup_rate FROM ranked")
def dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.duplicate_summary(_docs(spark, sf_dir))


@query(f"""WITH {_DOCS}, {_RANKED}, m AS (SELECT model, {_SUMMARY} FROM ranked GROUP BY model)
SELECT *, {_filled(_USD, tokens='total_tokens', model='model')} AS total_usd, {_filled(_USD, tokens='wasted_tokens', model='model')} AS wasted_usd FROM m""")
def dup_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.duplicates_by_model(_docs(spark, sf_dir))


_TOP = """, g AS (SELECT key, model, count(*) AS occurrences, min_by(tok, seq) AS first_tokens, min_by(text, seq) AS t FROM items GROUP BY key, model HAVING count(*) >= 2)
SELECT key, model, occurrences, first_tokens, (occurrences - 1) * first_tokens AS wasted_tokens, {preview} AS preview FROM g ORDER BY wasted_tokens DESC, key LIMIT 10"""
_PREVIEW = f"CASE WHEN strlen({_filled(_COLLAPSE, text='t')}) > 60 THEN list_max(list_transform(range(0, 58), lambda n: CASE WHEN strlen(left({_filled(_COLLAPSE, text='t')}, n)) <= 57 THEN left({_filled(_COLLAPSE, text='t')}, n) END)) || '...' ELSE {_filled(_COLLAPSE, text='t')} END"


@query(f"WITH {_EVENTS}{_filled(_TOP, preview=_PREVIEW)}")
def top_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.top_duplicates(_events(spark, sf_dir))


@query(f"WITH {_DOCS}{_filled(_TOP, preview=_PREVIEW)}")
def top_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.top_duplicates(_docs(spark, sf_dir))


@query(f"WITH {_DOCS} SELECT seq, model, key, tok AS est_tokens FROM items")
def fingerprint_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("seq", "model", "key", "est_tokens")


_NORMALIZED = "lower(" + _filled(_COLLAPSE, text=f"regexp_replace(text, '^[{text.WHITE}]+|[{text.WHITE}]+$', '', 'g')") + ")"


@query(f"SELECT doc_id AS seq, {_filled(_KEY, model="'embed-' || lang", text=_NORMALIZED)} AS key FROM documents")
def fingerprint_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.keyed(tables.document_items(spark, sf_dir), "trim,collapse,lowercase").select("seq", "key")


@query(f"SELECT doc_id, sha256({_NORMALIZED}) AS hash FROM documents")
def normalization_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules named in any order, with blanks; an unknown name is an error."""
    try:
        text.parse_rules("trim,shout")
    except ValueError:
        rules = text.parse_rules(" lowercase ,, collapse,trim ")
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.sha2(text.normalize(F.col("text"), rules), 256).alias("hash"))


def _sql_fold(c: str) -> str:
    for pair, letter in text.COMPOSED.items():
        c = f"replace({c}, '{pair}', '{letter}')"
    return c


@query(f"SELECT doc_id, md5(folded) AS digest, length(folded) AS n FROM (SELECT doc_id, {_sql_fold("replace(replace(text, 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771))")} AS folded FROM documents)")
def nfc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ñ"), F.lit("ñ"))
    return docs.select("doc_id", text.fold(apart).alias("folded")).select("doc_id", F.md5("folded").alias("digest"), F.length("folded").cast("long").alias("n"))


@query(f"SELECT page_id, CAST({_filled(_TOKENS, text='html')} AS BIGINT) AS est_tokens FROM pages")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", text.estimate_tokens(F.col("html")).alias("est_tokens"))


@query(f"SELECT lang, count(*) AS n, CAST(sum({_filled(_TOKENS, text='text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_estimate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(text.estimate_tokens(F.col("text"))).alias("tokens"))


@query(f"""WITH {_CONV}, b AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id) AS s, sum(tok) OVER (PARTITION BY conv_id) * 9 // 10 AS total FROM items),
r AS (SELECT *, total * tok // s AS base, row_number() OVER (PARTITION BY conv_id ORDER BY total * tok % s DESC, turn) AS rank FROM b)
SELECT conv_id, turn, CAST(CASE WHEN total <= 0 THEN tok ELSE base + CASE WHEN rank <= total - sum(base) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END END AS BIGINT) AS share FROM r""")
def apportion_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _conv(spark, sf_dir).withColumn("total", F.expr("sum(est_tokens) OVER (PARTITION BY conv_id) * 9 div 10"))
    return cost.apportion(items, "conv_id", "turn", "est_tokens", "total").select("conv_id", "turn", "share")


# --- request logs -------------------------------------------------------------------------------------------

_LOG = """log AS (SELECT doc_id AS seq, text AS head, 'embed-' || lang AS model, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE doc_id % 4 END AS shape FROM documents)"""


def _envelope_items(log: DataFrame) -> DataFrame:
    found = requests.parse(requests.extract(log).where("request IS NOT NULL"))
    return requests.items(found).select("seq", "pos", "model", identity.text_key(F.col("model"), F.col("text")).alias("key"))


@query(f"""WITH {_LOG}, r AS (SELECT seq, model, unnest(CASE WHEN shape IN (0, 2) THEN [{{'pos': 0, 'text': head}}] ELSE [{{'pos': 0, 'text': head}}, {{'pos': 1, 'text': 'same'}}] END) AS i FROM log WHERE shape IS NOT NULL)
SELECT seq, i.pos AS pos, model, {_filled(_KEY, model='model', text='i.text')} AS key FROM r""")
def envelope_items_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelope_items(tables.request_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT seq, CASE WHEN shape IS NULL OR shape IN (1, 3) THEN 400 ELSE 200 END AS status, CAST(CASE WHEN shape IS NULL THEN 0 WHEN shape IN (0, 2) THEN 1 ELSE 2 END AS INTEGER) AS n_items FROM log")
def request_status_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = requests.extract(tables.request_log(spark, sf_dir))
    return requests.status(log, most_items=1).select("seq", "status", F.coalesce("n_items", F.lit(0)).alias("n_items"))


@query("""SELECT event_id, CASE WHEN len(k) = 0 THEN '' ELSE sha256(list_reduce(list_transform(list_sort(k), lambda x: encode(x) || '\\x00'::BLOB || encode(json_extract_string(props, '$.' || x)) || '\\x00'::BLOB), lambda a, b: a || b)) END AS digest
FROM (SELECT event_id, props, json_keys(props) AS k FROM events)""")
def params_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events").withColumn("params", F.from_json("props", "map<string,string>"))
    return events.select("event_id", identity.params_digest(F.col("params")).alias("digest"))


# --- lookups ------------------------------------------------------------------------------------------------


def _cache(items: DataFrame, keep) -> DataFrame:
    return items.where(keep).groupBy("key").agg(F.min("seq").alias("tokens")).select("key", F.encode("key", "utf-8").alias("raw"), "tokens", F.lit(0).cast("long").alias("expires_at"))


_EVEN = "(SELECT DISTINCT key FROM items WHERE seq % 2 = 0)"


@query(f"WITH {_DOCS} SELECT seq, model FROM items WHERE key IN {_EVEN}")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _docs(spark, sf_dir)
    return lookup.hits(items, _cache(items, "seq % 2 = 0")).select("seq", "model")


@query(f"WITH {_DOCS} SELECT seq, model FROM items WHERE key NOT IN {_EVEN}")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _docs(spark, sf_dir)
    return lookup.misses(items, _cache(items, "seq % 2 = 0")).select("seq", "model")


@query(f"""WITH {_EVENTS}, c AS (SELECT DISTINCT key FROM items WHERE seq % 7 = 0), p AS (SELECT seq // 8 AS batch, i.key, c.key IS NOT NULL AS hit FROM items i LEFT JOIN c USING (key)),
g AS (SELECT batch, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, count(DISTINCT key) FILTER (WHERE NOT hit) AS computed FROM p GROUP BY batch)
SELECT *, CASE WHEN misses = 0 AND hits > 0 THEN 'hit' WHEN hits = 0 THEN 'miss' ELSE 'partial' END AS status FROM g""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _events(spark, sf_dir).withColumn("batch", F.expr("seq div 8"))
    return lookup.batch_status(lookup.probe(items, _cache(items, "seq % 7 = 0")), "batch")


@query(f"""WITH {_DOCS}, n AS (SELECT DISTINCT key FROM items WHERE seq % 3 = 0), f AS (SELECT DISTINCT key FROM items WHERE seq % 3 = 1)
SELECT seq, CASE WHEN key IN (SELECT key FROM n) THEN 'near' WHEN key IN (SELECT key FROM f) THEN 'far' ELSE 'none' END AS tier FROM items""")
def two_tier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _docs(spark, sf_dir)
    return lookup.two_tiers(items, _cache(items, "seq % 3 = 0"), _cache(items, "seq % 3 = 1")).select("seq", "tier")


@query(f"WITH {_CONV} SELECT conv_id, array_to_string(list(key ORDER BY turn), ',') AS keys, count(*) AS n FROM items GROUP BY conv_id")
def batch_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _conv(spark, sf_dir)
    computed = items.groupBy("key").agg(F.first("key").alias("raw"))
    whole = lookup.reassemble(lookup.scatter(items, computed), "conv_id", "turn", "raw")
    return whole.select("conv_id", F.array_join("values", ",").alias("keys"), F.size("values").cast("long").alias("n"))


@query(f"WITH {_EVENTS} SELECT seq // 8 AS batch, key, min(seq) AS first_pos FROM items WHERE key NOT IN (SELECT key FROM items WHERE seq % 7 = 0) GROUP BY ALL")
def distinct_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _events(spark, sf_dir).withColumn("batch", F.expr("seq div 8"))
    return lookup.distinct_missing(items, _cache(items, "seq % 7 = 0"), "batch", "seq")


@query("""SELECT event_id, CASE WHEN user_id % 20 = 0 THEN 'missing' WHEN user_id % 3 = 0 THEN 'ok' ELSE 'unknown' END AS verdict,
CASE WHEN user_id % 20 = 0 THEN '' ELSE left(sha256('key-' || user_id), 8) END AS caller FROM events""")
def auth_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    credential = F.when(F.col("user_id") % 20 == 0, "").otherwise(F.concat(F.lit("Bearer key-"), F.col("user_id").cast("string")))
    rows = tables.table(spark, sf_dir, "events").select("event_id", "user_id", credential.alias("credential"))
    allow = rows.where("user_id % 3 = 0").select(F.sha2(F.concat(F.lit("key-"), F.col("user_id").cast("string")), 256).alias("key_hash"))
    return lookup.allowed(rows, allow).select("event_id", "verdict", identity.caller_hash(F.col("credential")).alias("caller"))


# --- budgets ------------------------------------------------------------------------------------------------

_GATE = f"""{_EVENTS}, w AS (SELECT *, CAST(floor(epoch_us(ts) / {DAY * 1_000_000}) AS BIGINT) AS win, CASE WHEN CAST(caller AS BIGINT) % 5 = 0 THEN {OWN_LIMIT} WHEN CAST(caller AS BIGINT) % 5 = 1 THEN 0 ELSE {LIMIT} END AS token_limit FROM items),
b AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY caller, win ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w),
g AS (SELECT *, token_limit <= 0 OR s < token_limit AS allowed FROM b)"""


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = _events(spark, sf_dir).withColumns({"win": budget.window_id(F.col("ts"), DAY), "tokens": F.col("est_tokens")})
    callers = items.select("caller").distinct()
    n = F.col("caller").cast("long") % 5
    limits = callers.where(n < 2).select("caller", F.when(n == 0, OWN_LIMIT).otherwise(0).cast("long").alias("token_limit"))
    return budget.gate(budget.with_limits(items, limits, LIMIT)), limits


@query(f"WITH {_GATE} SELECT seq, caller, win, allowed, CAST(CASE WHEN allowed THEN tok ELSE 0 END AS BIGINT) AS spent FROM g")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir)[0].select("seq", "caller", "win", "allowed", F.col("spent").cast("long").alias("spent"))


@query(f"""WITH {_GATE}, l AS (SELECT caller, max(win) AS win FROM g GROUP BY caller), s AS (SELECT caller, min(token_limit) AS token_limit, sum(tok) FILTER (WHERE allowed) AS spent FROM g JOIN l USING (caller, win) GROUP BY caller)
SELECT caller, CAST(token_limit AS BIGINT) AS token_limit, CAST(spent AS BIGINT) AS spent, CAST(CASE WHEN token_limit <= 0 THEN -1 ELSE greatest(0, token_limit - spent) END AS BIGINT) AS remaining FROM s""")
def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated, limits = _gated(spark, sf_dir)
    return budget.report(gated, limits, LIMIT)


# --- usage --------------------------------------------------------------------------------------------------

_LEDGER = f"{_EVENTS}, {_RANKED}, l AS (SELECT *, rn > 1 AS hit, CASE WHEN rn > 1 THEN tok ELSE 0 END AS saved, CASE WHEN rn = 1 THEN tok ELSE 0 END AS spent FROM ranked)"
_USAGE = "count(*) AS items, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(spent) AS BIGINT) AS spent_tokens"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.outcomes(_events(spark, sf_dir))


@query(f"WITH {_LEDGER} SELECT caller, {_USAGE} FROM l GROUP BY caller")
def caller_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.usage(_ledger(spark, sf_dir), "caller")


@query(f"WITH {_LEDGER}, m AS (SELECT model, {_USAGE} FROM l GROUP BY model) SELECT *, {_filled(_USD, tokens='saved_tokens', model='model')} AS saved_usd FROM m")
def model_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.usage(_ledger(spark, sf_dir), "model")


_SAVINGS = f"""WITH {_LEDGER}, t AS (SELECT {_USAGE} FROM l)
SELECT items, hits, misses, CAST(0 AS BIGINT) AS coalesced, saved_tokens, spent_tokens, round(saved_tokens * 0.02::DOUBLE / 1e6, 9) AS saved_usd, hits / items AS hit_rate, round(saved_tokens / (saved_tokens + spent_tokens), 9) AS duplicate_share FROM t"""


@query(_SAVINGS)
def savings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.savings_report(_ledger(spark, sf_dir))
    return rows.withColumns({"saved_usd": F.round("saved_usd", 9), "duplicate_share": F.round("duplicate_share", 9)})


@query(f"""WITH r AS ({_SAVINGS}) SELECT unnest(['engine_items_total', 'engine_items_total', 'engine_items_total', 'engine_saved_tokens_total', 'engine_spent_tokens_total', 'engine_saved_usd']) AS metric,
unnest(['counter', 'counter', 'counter', 'counter', 'counter', 'gauge']) AS type, unnest(['hit', 'miss', 'coalesced', '', '', '']) AS label,
unnest([CAST(hits AS DOUBLE), CAST(misses AS DOUBLE), CAST(coalesced AS DOUBLE), CAST(saved_tokens AS DOUBLE), CAST(spent_tokens AS DOUBLE), saved_usd]) AS value FROM r""")
def prometheus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.prometheus(savings_report(spark, sf_dir))


@query("""WITH v AS (SELECT event_type, list_sort(list(value)) AS s, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, s[CAST(floor(0.5 * (n - 1)) AS BIGINT) + 1] AS p50, s[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1] AS p95, s[CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1] AS p99 FROM v""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.rank_floor_percentiles(tables.table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])


# --- replay -------------------------------------------------------------------------------------------------


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("t", budget.micros(F.col("ts")) / 1e6)


_FOLD = "list_reduce(list_prepend({'since': CAST(-1e18 AS DOUBLE), 'hits': CAST(0 AS BIGINT)}, list({'since': epoch_us(ts) / 1e6, 'hits': CAST(0 AS BIGINT)} ORDER BY ts, seq)), lambda a, x: CASE WHEN x.since <= a.since + {ttl} THEN {'since': a.since, 'hits': a.hits + 1} ELSE {'since': x.since, 'hits': a.hits} END)"


@query(f"WITH {_EVENTS} SELECT key, count(*) AS n, {_filled(_FOLD, ttl=3600)}.hits AS hits FROM items GROUP BY key")
def ttl_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay.expiry(_timed(spark, sf_dir), 3600)
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query(f"""WITH {_EVENTS}, s AS (SELECT key, seq, xor(ascii(left(key, 1)), ascii(right(key, 1))) % 16 AS shard, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev FROM items),
d AS (SELECT a.seq, count(DISTINCT b.key) AS between_ FROM s a LEFT JOIN s b ON b.shard = a.shard AND b.seq > a.prev AND b.seq < a.seq WHERE a.prev IS NOT NULL GROUP BY a.seq)
SELECT key, count(*) AS n, count(*) FILTER (WHERE between_ < 8) AS hits FROM s LEFT JOIN d USING (seq) GROUP BY key""")
def lru_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("size", F.octet_length("text"))
    return replay.eviction(rows, most_entries=128).groupBy("key").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query(f"""WITH {_EVENTS}, f AS (SELECT key, min_by(epoch_us(ts) / 1e6, (ts, seq)) AS t0, min_by(seq, (ts, seq)) AS owner FROM items GROUP BY key)
SELECT seq, owner, CASE WHEN seq = owner THEN 'miss' WHEN epoch_us(ts) / 1e6 <= t0 + 600 THEN 'coalesced' ELSE 'hit' END AS outcome FROM items JOIN f USING (key)""")
def coalesce_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.coalesced_within(_timed(spark, sf_dir), 600.0).select("seq", "owner", "outcome")


_BREAKER_STEP = """CASE WHEN a.open AND x.t - a.opened < 1800 THEN {'t': x.t, 'fault': x.fault, 'open': true, 'opened': a.opened, 'failures': a.failures, 'out': list_append(a.out, {'seq': x.seq, 'admitted': false, 'state': 'open'}), 'seq': x.seq}
WHEN NOT x.fault THEN {'t': x.t, 'fault': x.fault, 'open': false, 'opened': a.opened, 'failures': 0::BIGINT, 'out': list_append(a.out, {'seq': x.seq, 'admitted': true, 'state': 'closed'}), 'seq': x.seq}
WHEN a.open OR a.failures + 1 >= 2 THEN {'t': x.t, 'fault': x.fault, 'open': true, 'opened': x.t, 'failures': a.failures + 1, 'out': list_append(a.out, {'seq': x.seq, 'admitted': true, 'state': 'open'}), 'seq': x.seq}
ELSE {'t': x.t, 'fault': x.fault, 'open': false, 'opened': a.opened, 'failures': a.failures + 1, 'out': list_append(a.out, {'seq': x.seq, 'admitted': true, 'state': 'closed'}), 'seq': x.seq} END"""
_BREAKER_ROW = "{'t': %s, 'fault': %s, 'open': false, 'opened': 0::DOUBLE, 'failures': 0::BIGINT, 'out': []::STRUCT(seq BIGINT, admitted BOOLEAN, state VARCHAR)[], 'seq': %s}"


@query(f"""WITH {_EVENTS}, u AS (SELECT CAST(CAST(caller AS BIGINT) % 4 AS VARCHAR) AS upstream, list({_BREAKER_ROW % ("epoch_us(ts) / 1e6", "model = 'error'", "seq")} ORDER BY seq) AS l FROM items GROUP BY ALL),
r AS (SELECT upstream, unnest(list_reduce(list_prepend({_BREAKER_ROW % ("0::DOUBLE", "false", "-1::BIGINT")}, l), lambda a, x: {_BREAKER_STEP}).out) AS o FROM u) SELECT upstream, o.seq AS seq, o.admitted AS admitted, o.state AS state FROM r""")
def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("model") == "error", 503).when(F.col("model") == "click", 404).otherwise(200)
    attempts = _timed(spark, sf_dir).select((F.col("caller").cast("long") % 4).cast("string").alias("upstream"), "seq", "t", status.alias("status"))
    return replay.breaker(attempts, threshold=2, cooldown=1800.0)


_COUPLED_ROW = "{'seq': %s, 'k': %s, 'cw': %s, 'tok': %s, 'made': []::STRUCT(seq BIGINT, k BIGINT, cw BIGINT, tok BIGINT)[]}"


@query(f"""WITH {_EVENTS}, n AS (SELECT *, CAST(dense_rank() OVER (ORDER BY key) AS BIGINT) AS k, CAST(dense_rank() OVER (ORDER BY caller, floor(epoch_us(ts) / {DAY * 1_000_000})) AS BIGINT) AS cw FROM items),
f AS (SELECT list_reduce(list_prepend({_COUPLED_ROW % ("-1::BIGINT", "-1::BIGINT", "-1::BIGINT", "0::BIGINT")}, list({_COUPLED_ROW % ("seq", "k", "cw", "tok")} ORDER BY seq)),
lambda a, x: CASE WHEN len(list_filter(a.made, lambda m: m.k = x.k)) > 0 OR coalesce(list_sum(list_transform(list_filter(a.made, lambda m: m.cw = x.cw), lambda m: m.tok)), 0) >= {LIMIT} THEN a
ELSE {{'seq': x.seq, 'k': x.k, 'cw': x.cw, 'tok': x.tok, 'made': list_append(a.made, {{'seq': x.seq, 'k': x.k, 'cw': x.cw, 'tok': x.tok}})}} END).made AS made FROM n),
m AS (SELECT unnest(made) AS m FROM f) SELECT n.seq, caller, CASE WHEN n.seq = m.seq THEN 'miss' WHEN n.seq > m.seq THEN 'hit' ELSE 'refused' END AS outcome FROM n LEFT JOIN (SELECT m.k AS k, m.seq AS seq FROM m) m USING (k)""")
def coupled_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("seq", "caller", budget.window_id(F.col("ts"), DAY).alias("win"), "key", F.col("est_tokens").alias("tokens"), F.lit(LIMIT).alias("token_limit"))
    return replay.coupled_budget(rows)


# --- near-duplicates ----------------------------------------------------------------------------------------


def _sql_grams(id_: str, text_: str, table: str) -> str:
    padded = f"' ' || {_filled(_COLLAPSE, text=f'lower({text_})')} || ' '"
    return f"p AS (SELECT {id_} AS id, {padded} AS s FROM {table}), g AS (SELECT DISTINCT id, CASE WHEN length(s) < 3 THEN s ELSE substring(s, i, 3) END AS gram FROM (SELECT id, s, unnest(range(1, greatest(length(s) - 1, 2))) AS i FROM p)), z AS (SELECT id, count(*) AS n FROM g GROUP BY id), o AS (SELECT a.id AS q, b.id AS c, count(*) AS o FROM g a JOIN g b USING (gram) WHERE b.id < a.id GROUP BY ALL), j AS (SELECT q, c, o / (x.n + y.n - o) AS similarity FROM o JOIN z x ON q = x.id JOIN z y ON c = y.id)"


_NEAR = f"WITH {_sql_grams('conv_id * 1000 + turn', 'text', 'conversations')}"


def _near_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.conversation_items(spark, sf_dir).select(F.col("seq").alias("id"), "seq", "text")


def _numbered(found: DataFrame) -> DataFrame:
    return found.select(*[tables.turn_number(F.col(side)).alias(side) for side in "qc"], "similarity")


@query(f"{_NEAR} SELECT q, c, similarity FROM j WHERE similarity >= 0.6")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(similar.pairs(_near_rows(spark, sf_dir), 0.6, by=None))


@query(f"{_NEAR} SELECT q, c, similarity FROM j WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) = 1")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(similar.nearest_earlier(_near_rows(spark, sf_dir), 0.6, by=None))


@query(f"WITH {_sql_grams('item_id', 'text', 'benchmark')} SELECT q, c, similarity FROM j QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) = 1")
def most_similar_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    grams = lambda side: items.select(F.col("id").alias(side), text.trigram_codes(F.col("text")).alias("g")).select(side, F.size("g").alias(f"{side}_n"), F.explode("g").alias("gram"))
    met = grams("q").join(grams("c"), "gram").where("c < q").groupBy("q", "q_n", "c", "c_n").agg(F.count("*").alias("o"))
    return similar.nearest(met.select("q", "c", (F.col("o") / (F.col("q_n") + F.col("c_n") - F.col("o"))).alias("similarity")))


def _by_role(grams: str) -> str:
    """The same within each role."""
    return grams.replace("AS id, ' '", "AS id, role, ' '", 1).replace("SELECT DISTINCT id, CASE", "SELECT DISTINCT id, role, CASE").replace("(SELECT id, s, unnest", "(SELECT id, role, s, unnest").replace("USING (gram)", "USING (gram, role)")


def _sql_shadow() -> str:
    from lodestone.plans.services import sql_vectors

    grams = _by_role(_sql_grams("conv_id * 1000 + turn", "text", "conversations"))
    vectors_ = sql_vectors("role", "text", 8, "conversations", "conv_id * 1000 + turn AS id").replace("unhex(d", "unhex(d")
    return f"""WITH {grams}, b AS (SELECT * FROM j WHERE similarity >= 0.4 QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c) = 1), {vectors_}, e AS (SELECT id, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS e FROM vectors),
w AS (SELECT similarity, list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) AS cosine FROM b JOIN e x ON q = x.id JOIN e y ON c = y.id), t AS (SELECT unnest([0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE]) AS threshold)
SELECT threshold, count(*) AS n, round(avg(cosine), 9) AS mean_cosine, round(min(cosine), 9) AS min_cosine, min(cosine) >= 0.95 AS safe FROM w JOIN t ON similarity >= threshold GROUP BY threshold"""


@query()
def shadow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.conversation_items(spark, sf_dir).select(F.col("seq").alias("id"), "seq", "text", "model")
    found = stored(similar.nearest_earlier(rows, 0.4), "nearest-rows")
    wanted = found.select(F.col("q").alias("id")).union(found.select("c")).distinct()
    v = rows.join(wanted, "id", "left_semi").select("id", mock.embed(F.col("model"), F.col("text"), 64).alias("v"))
    swept = similar.sweep(similar.shadow(found, v), [0.4, 0.5, 0.6])
    return swept.withColumns({c: F.round(c, 9) for c in ("mean_cosine", "min_cosine")})


def _sql_active(grams: str, threshold: float) -> str:
    """Rows one by one in order of id: a row with a leader among its earlier neighbours is served, the others lead."""
    return f"""WITH {grams}, n AS (SELECT q AS id, list(c) AS near FROM j WHERE similarity >= {threshold} GROUP BY q),
f AS (SELECT list_reduce(list_prepend({{'id': CAST(0 AS BIGINT), 'near': CAST([] AS BIGINT[]), 'lead': (SELECT coalesce(list(id), []) FROM p WHERE id NOT IN (SELECT id FROM n))}}, list({{'id': id, 'near': near, 'lead': CAST([] AS BIGINT[])}} ORDER BY id)),
lambda a, x: {{'id': x.id, 'near': x.near, 'lead': CASE WHEN len(list_intersect(a.lead, x.near)) = 0 THEN list_append(a.lead, x.id) ELSE a.lead END}}).lead AS lead FROM n),
l AS (SELECT unnest(lead) AS id FROM f), s AS (SELECT q, c, similarity FROM j JOIN l ON j.c = l.id WHERE similarity >= {threshold} QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, CAST(c AS VARCHAR)) = 1)
SELECT CAST(p.id AS VARCHAR) AS id, CAST(coalesce(s.c, p.id) AS VARCHAR) AS served_by, round(coalesce(s.similarity, 1.0), 9) AS similarity FROM p LEFT JOIN s ON s.q = p.id"""


def _served(rows: DataFrame, threshold: float) -> DataFrame:
    return similar.active(rows, threshold).withColumn("similarity", F.round("similarity", 9))


@query(_sql_active(_sql_grams("item_id", "text", "benchmark"), 0.3))
def active_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _served(tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("seq"), "text"), 0.3)


@query(_sql_active(_by_role(_sql_grams("conv_id * 1000 + turn", "text", "conversations")), 0.5))
def active_semantic_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations in order, each role apart."""
    rows = tables.conversation_items(spark, sf_dir).select(tables.turn_number(F.col("seq")).alias("id"), "seq", "text", "model")
    return _served(rows, 0.5)


# --- retrieval ----------------------------------------------------------------------------------------------

# Every hundredth row is a query, against all rows but its own.
_COS = """v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.id AS qid, c.id, q.label = c.label AS same, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
FROM v q JOIN v c ON q.id % 100 = 0 AND c.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS rank FROM s)"""


def _search(v: DataFrame, k: int) -> DataFrame:
    return retrieval.rank(v.where("id % 100 = 0").select(F.col("id").alias("qid"), "v"), v.select("id", "v"), k, others=True)


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return _search(tables.vectors(spark, sf_dir), k)


@query(f"WITH {_COS} SELECT qid, id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def cosine_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, 10).select("qid", "id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {_COS} SELECT qid, id, round(score, 9) AS score FROM r WHERE rank = 1")
def cosine_argmax_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.argmax(_ranked(spark, sf_dir, 1)).select("qid", "id", F.round("score", 9).alias("score"))


_IDEAL = "i AS (SELECT qid, count(*) AS n FROM s WHERE same GROUP BY qid)"


@query(f"""WITH {_COS}, {_IDEAL}, d AS (SELECT qid, sum(CASE WHEN same THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r WHERE rank <= 10 GROUP BY qid)
SELECT qid, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1 / log2(k + 1))), 0), 9) AS ndcg FROM d LEFT JOIN i USING (qid)""")
def ndcg_at_10_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.labelled_ndcg(_ranked(spark, sf_dir, 100), tables.vectors(spark, sf_dir), 10).select("qid", F.round("ndcg", 9).alias("ndcg"))


@query(f"WITH {_COS}, {_IDEAL} SELECT qid, round(coalesce(count(*) FILTER (WHERE same) / any_value(n), 0), 9) AS recall FROM r LEFT JOIN i USING (qid) WHERE rank <= 100 GROUP BY qid")
def recall_at_100_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.labelled_recall(_ranked(spark, sf_dir, 100), tables.vectors(spark, sf_dir), 100).select("qid", F.round("recall", 9).alias("recall"))


_COARSE = _COS.replace("CAST(embedding AS DOUBLE[]) AS e", "list_transform(embedding, lambda x: floor(4 * CAST(x AS DOUBLE))) AS e")


@query(f"""WITH a AS (WITH {_COS} SELECT qid, rank, id FROM r WHERE rank <= 10), b AS (WITH {_COARSE} SELECT qid, rank, id FROM r WHERE rank <= 10)
SELECT count(*) AS places, count(*) FILTER (WHERE a.id IS DISTINCT FROM b.id) AS different FROM a FULL JOIN b USING (qid, rank)""")
def ranking_identity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that change when vectors are rounded to quarters."""
    v = tables.vectors(spark, sf_dir)
    coarse = v.withColumn("v", F.transform("v", lambda x: F.floor(4 * x).cast("double")))
    return retrieval.same_ranking(_search(v, 10), _search(coarse, 10), 10)


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.vectors(spark, sf_dir)
    a, b = v.select(F.col("id").alias("a"), F.col("v").alias("x")), v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("v").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 9).alias("cosine"))


@query("""WITH p AS (SELECT lang, left(text, 60) AS prefix, text, length(text) AS score FROM documents), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY lang, prefix ORDER BY score DESC, text) = 1)
SELECT lang, md5(text) AS digest, score, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, text) AS INTEGER) AS place FROM f QUALIFY place <= 25""")
def result_dedup_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("lang", "text", F.length("text").cast("long").alias("score"))
    return retrieval.merge_variants(docs, "lang", "text", "score", 25).select("lang", F.md5("text").alias("digest"), "score", "place")


# --- chunking -----------------------------------------------------------------------------------------------

_EDITED = f"""SELECT doc_id, before, CASE WHEN doc_id % 20 = 0 THEN left(before, place) || '{tables.SENTENCE}' || substring(before, place + 1) ELSE before END AS after
FROM (SELECT *, length(before) // 3 + greatest(strpos(substring(before, length(before) // 3 + 1), chr(10) || chr(10)) - 1, 0) AS place FROM (SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS before FROM documents))"""


def _sql_fixed(id_: str, c: str, table: str) -> str:
    hexed = f"hex(encode({c}))"
    return f"SELECT {id_} AS doc_id, i AS ordinal, sha256(unhex(substring(h, i * 1600 + 1, 1600))) AS hash, length(substring(h, i * 1600 + 1, 1600)) // 2 AS size FROM (SELECT {id_}, {hexed} AS h, unnest(range(0, (strlen({c}) + 799) // 800)) AS i FROM {table})"


@query(f"SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(size AS INTEGER) AS size, hash FROM ({_sql_fixed('doc_id', 'text', 'documents')})")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    return chunking.exploded(docs, chunking.fixed_chunks(F.col("text")), "doc_id").select("doc_id", "ordinal", "size", "hash")


@query(f"""WITH e AS ({_EDITED}), a AS ({_sql_fixed('doc_id', 'before', 'e')}), b AS ({_sql_fixed('doc_id', 'after', 'e')}), k AS (SELECT DISTINCT doc_id, hash FROM a)
SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE k.hash IS NOT NULL) AS unchanged, count(*) FILTER (WHERE k.hash IS NULL) AS changed FROM b LEFT JOIN k USING (doc_id, hash) GROUP BY doc_id""")
def fixed_chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.edited_documents(spark, sf_dir)
    before, after = (chunking.exploded(docs, chunking.fixed_chunks(F.col(c)), "doc_id") for c in ("before", "after"))
    return chunking.difference(before, after, ["doc_id"])


def _sql_cut(rows: str, most: int = chunking.MOST) -> str:
    """WITH parts that give `chunks` (id, ordinal, start, size, hash) of the rows (id, text): the low 11 bits of the rolling hash
    at every byte as a sum over the last 11 bytes, and the cuts of each text one after another."""
    least, average = chunking.LEAST, chunking.AVERAGE
    window = " + ".join(f"{1 << k} * g[i + {10 - k}]" for k in range(11))
    fresh = " + ".join(f"CASE WHEN j >= {k} THEN {1 << k} * g[f + j + {11 - k}] ELSE 0 END" for k in range(10))
    return f"""gear AS (SELECT list(('0x' || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT & 2047 ORDER BY b) AS gear FROM (SELECT b, sha256(unhex(printf('%02X', b))) AS h FROM range(0, 256) t(b))),
p AS (SELECT id, hex(encode(text)) AS h, list_concat([0, 0, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: gear[('0x' || x)::BIGINT + 1])) AS g, strlen(text) AS n FROM ({rows}), gear WHERE strlen(text) > 0),
q AS (SELECT id, list_transform(range(1, n + 1), lambda i: ({window}) % 2048) AS r FROM p),
c AS (SELECT p.id, h, g, n, list_filter(range(0, n), lambda i: r[i + 1] = 0) AS strict, list_filter(range(0, n), lambda i: r[i + 1] % 128 = 0) AS loose FROM p JOIN q USING (id)),
cuts AS MATERIALIZED (WITH RECURSIVE w(id, ordinal, start, upto) AS (SELECT id, -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM c UNION ALL SELECT w.id, w.ordinal + 1, w.upto, CASE WHEN n - w.upto <= {least} THEN n ELSE coalesce(
  (SELECT min(w.upto + {least} + j + 1) FROM range(0, 10) t(j) WHERE w.upto + {least} + j < least(w.upto + {average}, n, w.upto + {most}) AND (SELECT ({fresh}) % 2048 FROM (SELECT w.upto + {least} AS f)) = 0),
  list_min(list_filter(strict, lambda i: i >= w.upto + {least} + 10 AND i < least(w.upto + {average}, n, w.upto + {most}))) + 1, list_min(list_filter(loose, lambda i: i >= w.upto + {average} AND i < least(n, w.upto + {most}))) + 1, least(n, w.upto + {most})) END
  FROM w JOIN c USING (id) WHERE w.upto < n) SELECT * FROM w WHERE ordinal >= 0),
chunks AS (SELECT id, ordinal, start, upto - start AS size, sha256(unhex(substring(h, 2 * start + 1, 2 * (upto - start)))) AS hash FROM cuts JOIN c USING (id))"""


@query(f"WITH {_sql_cut('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, CAST(ordinal AS INTEGER) AS ordinal, start AS \"offset\", CAST(size AS INTEGER) AS size, hash FROM chunks")
def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    return chunking.exploded(docs, chunking.content_chunks(F.col("text")), "doc_id").select("doc_id", "ordinal", "offset", "size", "hash")


@query(f"WITH {_sql_cut('SELECT doc_id AS id, text FROM documents', 1000)} SELECT id AS doc_id, count(*) AS n, max(size)::INTEGER AS longest FROM chunks GROUP BY id")
def cdc_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 1000 bytes, with defaults for the sizes that are not positive."""
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    rows = chunking.exploded(docs, chunking.content_chunks(F.col("text"), *chunking.options(-5, 0, 1000)), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("size").alias("longest"))


@query(f"""WITH e AS MATERIALIZED ({_EDITED}), {_sql_cut("SELECT 2 * doc_id AS id, before AS text FROM e UNION ALL SELECT 2 * doc_id + 1, after FROM e WHERE after <> before")}, k AS (SELECT DISTINCT id // 2 AS doc_id, hash FROM chunks WHERE id % 2 = 0),
v AS (SELECT id // 2 AS doc_id, max(id) AS id FROM chunks GROUP BY ALL) SELECT v.doc_id, count(*) AS total, count(*) FILTER (WHERE k.hash IS NOT NULL) AS unchanged, count(*) FILTER (WHERE k.hash IS NULL) AS changed FROM v JOIN chunks USING (id) LEFT JOIN k ON k.doc_id = v.doc_id AND k.hash = chunks.hash GROUP BY v.doc_id""")
def cdc_chunk_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.edited_documents(spark, sf_dir).withColumns({"b": chunking.content_chunks(F.col("before")), "a": chunking.content_chunks(F.when(F.col("after") != F.col("before"), F.col("after")))})
    docs = docs.withColumn("a", F.when(F.col("after") != F.col("before"), F.col("a")).otherwise(F.col("b")))  # the same text has the same chunks
    return chunking.difference_of(docs.select("doc_id", F.col("b").alias("before"), F.col("a").alias("after")), "doc_id")


@query()
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(chunking.packed_paragraphs("text")).alias("ordinal", "chunk"))


@query("SELECT doc_id, p AS paragraph FROM (SELECT doc_id, unnest(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: strlen(p) >= 120 AND NOT starts_with(p, '==')), lambda p: left(p, 600))) AS p FROM documents)")
def paragraph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(chunking.paragraphs(F.col("text"))).alias("paragraph"))


# --- backend and streams ------------------------------------------------------------------------------------


@query()
def mock_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.table(spark, sf_dir, "benchmark")
    return items.select("item_id", mock.embed(F.lit("m"), F.col("text"), 32).alias("vector"))


@query()
def computed_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _docs(spark, sf_dir)
    return mock.compute_missing(items, _cache(items, "seq % 2 = 0"), 8)


def _stream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = live.table_stream(spark, f"{sf_dir}/events.parquet")
    items = events.select(F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("model"), F.col("props").alias("text"))
    return ledger.keyed(items)


@query(f"WITH {_EVENTS} SELECT DISTINCT key, model FROM items")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.first_seen(_stream_items(spark, sf_dir)).select("key", "model"))


@query(f"WITH {_EVENTS} SELECT model, count(*) AS items, CAST(sum(tok) AS BIGINT) AS tokens, {_filled(_USD, tokens='sum(tok)', model='model')} AS usd FROM items GROUP BY model")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.running_usage(_stream_items(spark, sf_dir), "model"), "complete")


@query(f"WITH {_EVENTS} SELECT key, count(*) AS n, {_filled(_FOLD, ttl=3600)}.hits AS hits FROM items GROUP BY key")
def stream_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _stream_items(spark, sf_dir).select("key", "seq", F.floor(budget.micros(F.col("ts")) / 1000).alias("t_ms"), F.col("ts").cast("timestamp").alias("at"))
    rows = live.drained(live.expiring(items, 3_600_000))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query(f"WITH {_EVENTS}, d AS (SELECT CAST(floor(epoch_us(ts) / {DAY * 1_000_000}) AS BIGINT) AS win, count(*) AS n, CAST(sum(tok) AS BIGINT) AS t FROM items GROUP BY win) SELECT win, CAST(sum(n) OVER (ORDER BY win) AS BIGINT) AS items, CAST(sum(t) OVER (ORDER BY win) AS BIGINT) AS tokens, n AS items_delta, t AS tokens_delta FROM d")
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_day = _events(spark, sf_dir).groupBy(budget.window_id(F.col("ts"), DAY).alias("win")).agg(F.count("*").alias("n"), F.sum("est_tokens").alias("tokens"))
    snapshots = scan.running(per_day, [], ["win"], {"items": "n", "total": "tokens"}).select("win", "items", F.col("total").alias("tokens"))
    return ledger.counter_deltas(snapshots, "win", ["items", "tokens"])


@query(f"WITH {_EVENTS}{_filled(_TOP, preview=_PREVIEW)}")
def heavy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top duplicates by a sketch of 64 counters at first, and an exact count of its keys."""
    return heavy.top_duplicates(_events(spark, sf_dir), most=64)


@query(f"WITH {_EVENTS}{_filled(_TOP, preview=_PREVIEW)}")
def stream_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the sketch that a stream has kept."""
    path = f"{live.shared_dir(spark)}/heavy-{live.unique()}"
    live.heavy_keys(_stream_items(spark, sf_dir).select("key", "est_tokens"), path, f"{path}-checkpoint", 512).awaitTermination()
    return heavy.top_duplicates(_events(spark, sf_dir), most=512, first=live.tier(spark, path))


# Modules that register queries of their own.
from lodestone.plans import logs, services  # noqa: E402, F401

ORACLE["shadow_summary"] = _sql_shadow()
