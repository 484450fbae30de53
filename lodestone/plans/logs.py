"""Queries over request logs: analysis end to end, identity of every input shape, validation, round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import identity
from lodestone.operators import analyze, ledger, scan
from lodestone.plans.registry import _TOKENS, _USD, _filled, query
from lodestone.sources import lines, requests, tables
from lodestone.streaming import live

_MODEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.MODELS.items()) + " ELSE event_type END"
_NUL = "'\\x00'::BLOB"


def _sql_tokens(*tokens: str) -> str:
    return "encode('t') || " + _NUL + " || unhex(" + " || ".join(f"printf('%02X', {t}) || '00000000000000'" for t in tokens) + ")"


def _sql_text(text: str) -> str:
    return f"encode('s') || {_NUL} || encode({text})"


def _sql_shape(shape: int, pos: int, body: str, tokens: str, preview: str, dims: str = "0", enc: str = "", digest: str = "''") -> str:
    key = f" || {_NUL} || ".join(["encode('ec2')", "encode(model)", f"encode('{dims}')", f"encode('{enc}')", f"encode({digest})", body])
    return f"SELECT seq, {pos} AS pos, model, sha256({key}) AS key, CAST({tokens} AS BIGINT) AS tok, {preview} AS preview FROM e WHERE shape = {shape}"


_DIGEST = f"sha256(encode('temperature') || {_NUL} || encode(CASE WHEN odd = 1 THEN '1.50' ELSE '1.5' END) || {_NUL})"
_SHAPES = [
    _sql_shape(0, 0, _sql_text("props"), _filled(_TOKENS, text="props"), "props"),
    _sql_shape(1, 0, _sql_text("props"), _filled(_TOKENS, text="props"), "props", dims="256"),
    _sql_shape(1, 1, _sql_text("'same'"), "1", "'same'", dims="256"),
    _sql_shape(2, 0, _sql_tokens("a", "b"), "2", "'<2 pre-tokenized tokens>'", enc="base64"),
    _sql_shape(3, 0, _sql_tokens("a"), "1", "'<1 pre-tokenized tokens>'"),
    _sql_shape(3, 1, _sql_tokens("b", "a"), "2", "'<2 pre-tokenized tokens>'"),
    _sql_shape(4, 0, _sql_text("'note ' || b"), "2", "'note ' || b", digest=_DIGEST),
    _sql_shape(7, 0, _sql_text("''"), "1", "''"),
]
_LINES = f"e AS (SELECT event_id AS seq, props, user_id % 200 AS a, event_id % 7 AS b, event_id // 8 % 2 AS odd, event_id % 8 AS shape, {_MODEL} AS model FROM events)"
_ITEMS = f"{_LINES}, items AS ({' UNION ALL '.join(_SHAPES)})"
_RANKED = f"{_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq, pos) AS rn FROM items)"
_COUNTS = "count(*) AS items, count(*) FILTER (WHERE rn = 1) AS unique_items, count(*) FILTER (WHERE rn > 1) AS dup_items, CAST(sum(tok) AS BIGINT) AS total_tokens, CAST(coalesce(sum(tok) FILTER (WHERE rn > 1), 0) AS BIGINT) AS wasted_tokens"
_BY_MODEL = f"{_RANKED}, m AS (SELECT model, {_COUNTS} FROM r GROUP BY model), u AS (SELECT *, {_filled(_USD, tokens='total_tokens', model='model')} AS total_usd, {_filled(_USD, tokens='wasted_tokens', model='model')} AS wasted_usd FROM m)"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.parsed(tables.spread(tables.api_log(spark, sf_dir)))


@query(f"""WITH {_BY_MODEL} SELECT (SELECT count(*) FROM e WHERE shape NOT IN (5, 6)) AS requests, (SELECT count(*) FROM e WHERE shape IN (5, 6)) AS skipped,
CAST(sum(items) AS BIGINT) AS items, CAST(sum(unique_items) AS BIGINT) AS unique_items, CAST(sum(dup_items) AS BIGINT) AS dup_items, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(wasted_tokens) AS BIGINT) AS wasted_tokens,
round(sum(total_usd), 9) AS total_usd, round(sum(wasted_usd), 9) AS wasted_usd, round(sum(dup_items) / sum(items), 9) AS dup_rate FROM u""")
def analyze_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = analyze.summary(analyze.state(tables.spread(tables.api_log(spark, sf_dir))))
    return whole.withColumns({c: F.round(c, 9) for c in ("total_usd", "wasted_usd", "dup_rate")})


@query(f"WITH {_BY_MODEL} SELECT model, items, unique_items, dup_items, total_tokens, wasted_tokens, round(total_usd, 9) AS total_usd, round(wasted_usd, 9) AS wasted_usd FROM u")
def analyze_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.duplicates_by_model(analyze.items(_parsed(spark, sf_dir)))
    return rows.withColumns({c: F.round(c, 9) for c in ("total_usd", "wasted_usd")})


@query(f"""WITH {_RANKED}, g AS (SELECT key, model, count(*) AS occurrences, min_by(tok, (seq, pos)) AS first_tokens, min_by(preview, (seq, pos)) AS preview FROM items GROUP BY key, model HAVING count(*) >= 2)
SELECT key, model, occurrences, first_tokens, (occurrences - 1) * first_tokens AS wasted_tokens, preview FROM g ORDER BY wasted_tokens DESC, key LIMIT 10""")
def analyze_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.top(analyze.state(tables.spread(tables.api_log(spark, sf_dir))))


@query(f"""WITH {_BY_MODEL} SELECT model, items, unique_items, dup_items, total_tokens, wasted_tokens FROM u""")
def analyze_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten logs, written out and added one by one, the last first and one of them twice."""
    path = f"{live.shared_dir(spark)}/log-{live.unique()}"
    log = tables.api_log(spark, sf_dir)
    log.select((F.col("seq") % 10).alias("log"), F.concat(F.lpad(F.col("seq").cast("string"), 12, "0"), F.lit(" "), "value").alias("value")).write.partitionBy("log").text(path)
    whole = analyze.Analysis(spark, f"{path}-analysis")
    for k in (*reversed(range(10)), 4):
        rows = lines.read_lines(spark, f"{path}/log={k}").select(F.substring("value", 1, 12).cast("long").alias("seq"), F.expr("substring(value, 14)").alias("value"))
        whole.add(rows, str(k), 0)
    return analyze.by_model(whole.state()).drop("total_usd", "wasted_usd")


_ANALYSIS = f"""t AS (SELECT key, model, count(*) AS occurrences, min_by(tok, (seq, pos)) AS first_tokens, min_by(preview, (seq, pos)) AS preview FROM items GROUP BY key, model HAVING count(*) >= 2)"""


@query(f"""WITH {_BY_MODEL}, {_ANALYSIS} SELECT 'requests' AS name, CAST(count(*) AS VARCHAR) AS value FROM e WHERE shape NOT IN (5, 6) UNION ALL SELECT 'skipped', CAST(count(*) AS VARCHAR) FROM e WHERE shape IN (5, 6)
UNION ALL SELECT 'unique_items', CAST(sum(unique_items) AS VARCHAR) FROM u UNION ALL SELECT 'models', string_agg(model || ' ' || items || ' ' || dup_items, ',' ORDER BY model) FROM u
UNION ALL SELECT 'top', string_agg(key, ',' ORDER BY w DESC, key) FROM (SELECT key, (occurrences - 1) * first_tokens AS w FROM t ORDER BY w DESC, key LIMIT 10)""")
def analysis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of an analysis as one JSON object, and values read back from it."""
    report = analyze.as_json(*analyze.analyze(tables.spread(tables.api_log(spark, sf_dir))))
    at = lambda p: F.get_json_object("value", p)
    models = F.from_json(at("$.models"), "array<struct<model:string,items:long,dup_items:long>>")
    top = F.from_json(at("$.top_duplicates"), "array<struct<key:string>>")
    named = {"requests": at("$.requests"), "skipped": at("$.skipped"), "unique_items": at("$.unique_items"), "models": F.array_join(F.transform(models, lambda m: F.concat_ws(" ", m["model"], m["items"], m["dup_items"])), ","), "top": F.array_join(F.transform(top, lambda t: t["key"]), ",")}
    return report.select(F.explode(F.create_map(*[x for k, c in named.items() for x in (F.lit(k), c)])).alias("name", "value"))


@query(f"WITH {_ITEMS} SELECT seq, CAST(pos AS INTEGER) AS pos, model, key, tok AS est_tokens, preview FROM items")
def request_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.items(_parsed(spark, sf_dir)).select("seq.seq", "seq.pos", "model", "key", "est_tokens", "preview")


@query(f"""WITH {_LINES} SELECT seq, CASE WHEN shape = 1 AND strlen(model) >= 22 THEN 413 WHEN shape IN (1, 3, 5, 6) THEN 400 ELSE 200 END AS status FROM e""")
def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = requests.extract(tables.api_log(spark, sf_dir))
    body = F.when(F.col("seq") % 8 == 1, F.octet_length(F.get_json_object("value", "$.body.model"))).otherwise(0)
    padded = log.withColumn("body", F.repeat(F.lit("x"), body))
    return requests.status(padded, most_items=1, most_bytes=21, body="body").select("seq", "status")


@query(f"WITH {_LINES} SELECT seq, {_DIGEST} AS digest FROM e WHERE shape = 4")
def params_digest_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir).where("params IS NOT NULL")
    return rows.select("seq", identity.params_digest(F.col("params")).alias("digest"))


_QUOTED = "'\"' || replace(props, '\"', '\\\"') || '\"'"


@query(f"""WITH {_LINES} SELECT seq, CASE shape WHEN 0 THEN '{{"input":' || {_QUOTED} || ',"model":"' || model || '"}}' WHEN 1 THEN '{{"dimensions":256,"input":[' || {_QUOTED} || ',"same"],"model":"' || model || '"}}'
WHEN 2 THEN '{{"encoding_format":"base64","input":[' || a || ',' || b || '],"model":"' || model || '"}}' WHEN 3 THEN '{{"input":[[' || a || '],[' || b || ',' || a || ']],"model":"' || model || '","user":"u"}}'
WHEN 4 THEN '{{"input":"note ' || b || '","model":"' || model || '","temperature":' || CASE WHEN odd = 1 THEN '1.50' ELSE '1.5' END || '}}' WHEN 6 THEN '{{"input":[],"model":"' || model || '"}}' ELSE '{{"input":null,"model":"' || model || '"}}' END AS value FROM e WHERE shape <> 5""")
def request_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir).where("model IS NOT NULL")
    once = rows.select("seq", requests.encode_request("model", "input", "dimensions", "encoding_format", "user", "params").alias("value"))
    again = analyze.parsed(once).select("seq", requests.encode_request("model", "input", "dimensions", "encoding_format", "user", "params").alias("value"))
    return again


@query("SELECT event_id AS seq, 'p\"' || event_type || '\\' || chr(10) || user_id AS name, '\"' || replace(props, '\"', '\\\"') || '\"' AS value FROM events")
def parameter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters with quotes, backslashes and line breaks in their names, written as requests and read again."""
    name = F.concat(F.lit('p"'), "event_type", F.lit("\\\n"), F.col("user_id").cast("string"))
    value = F.regexp_replace(F.to_json(F.array("props")), r"^\[|\]$", "")
    rows = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("m").alias("model"), F.lit('"x"').alias("input"), F.lit(None).cast("int").alias("dimensions"), F.lit("").alias("encoding_format"), F.lit("").alias("user"), F.create_map(name, value).alias("params"))
    lines = rows.select("seq", requests.encode_request("model", "input", "dimensions", "encoding_format", "user", "params").alias("value"))
    return analyze.parsed(lines).select("seq", F.explode("params").alias("name", "value"))


@query(f"WITH {_ITEMS} SELECT seq // 16 AS batch, '[' || string_agg('\"' || replace(preview, '\"', '\\\"') || '\"', ',' ORDER BY seq, pos) || ']' AS input FROM items WHERE preview NOT LIKE '<%' GROUP BY ALL")
def encoded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = requests.items(_parsed(spark, sf_dir)).where("NOT is_tokens").select(F.expr("seq div 16").alias("batch"), F.struct("seq", "pos").alias("at"), "text")
    return requests.encode_inputs(texts, "batch", "at")


@query(f"""WITH {_LINES} SELECT seq, CASE WHEN shape = 2 THEN '[[' || a || ',' || b || ']]' ELSE '[[' || a || '],[' || b || ',' || a || ']]' END AS input FROM e WHERE shape IN (2, 3)""")
def encoded_token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = requests.items(_parsed(spark, sf_dir)).where("is_tokens")
    return requests.encode_inputs(tokens, "seq", "pos", tokens="tokens")


@query(f"WITH {_ITEMS} SELECT key, model, count(*) AS n FROM items GROUP BY ALL")
def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of files of lines, to items and live counts by key."""
    path = f"{live.shared_dir(spark)}/log-{live.unique()}"
    tables.api_log(spark, sf_dir).select(F.concat(F.col("seq").cast("string"), F.lit(" "), "value").alias("value")).write.text(path)
    lines = live.line_stream(spark, path).select(F.substring_index("value", " ", 1).cast("long").alias("seq"), F.expr("substring(value, instr(value, ' ') + 1)").alias("value"))
    counts = analyze.items(analyze.parsed(lines)).groupBy("key", "model").agg(F.count("*").alias("n"))
    return live.drained(counts, "complete")


@query(f"WITH {_LINES} SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS at FROM e")
def log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as two logs of rising size and read again in order."""
    path = f"{live.shared_dir(spark)}/log-{live.unique()}"
    log = tables.api_log(spark, sf_dir).select("seq", F.to_json(F.struct("seq")).alias("value"))
    log.where("seq < 100").coalesce(1).sortWithinPartitions("seq").select("value").write.text(f"{path}/first")
    log.where("seq >= 100").repartitionByRange(8, "seq").sortWithinPartitions("seq").select("value").write.text(f"{path}/second")
    rows = requests.read_log(spark, [f"{path}/first", f"{path}/second"])
    return rows.select(F.get_json_object("value", "$.seq").cast("long").alias("seq"), F.col("seq").alias("at"))


@query(f"WITH {_LINES} SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS at FROM e")
def log_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of rising size read by byte ranges that cut lines, and numbered by places."""
    path = f"{live.shared_dir(spark)}/log-{live.unique()}"
    log = tables.api_log(spark, sf_dir).select("seq", F.to_json(F.struct("seq")).alias("text"))
    log.where("seq < 100").coalesce(1).sortWithinPartitions("seq").select("text").write.text(f"{path}/first")
    log.where("seq >= 100").repartitionByRange(8, "seq").sortWithinPartitions("seq").select("text").write.text(f"{path}/second")
    rows = lines.read_lines(spark, [f"{path}/first", f"{path}/second"], split_bytes=50_000)
    return scan.places(rows, [], ["seq"], "at").select(F.get_json_object("value", "$.seq").cast("long").alias("seq"), "at")
