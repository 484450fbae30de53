"""The test tables as the engine's inputs: items, vectors, request logs, edited documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCE = "This sentence was inserted by an edit. "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, task_bytes: int = 0) -> DataFrame:
    """A scan's rows, dealt out to all tasks where its files fill fewer than there are slots (as a file of one row group fills
    one), so that work on each row uses them all. Large inputs are left where they lie, unless `task_bytes` is given: then they are
    dealt out where fewer tasks have rows than the files hold so many bytes, so that tasks do not grow with the input."""
    slots = rows.sparkSession.sparkContext.defaultParallelism
    plan = rows._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation":
        return rows  # asking for its partitions would run its shuffles
    wanted = int(str(plan.stats().sizeInBytes())) // task_bytes if task_bytes else 0
    if rows._jdf.queryExecution().toRdd().getNumPartitions() > max(4 * slots, wanted):
        return rows
    full = rows.select(F.spark_partition_id().alias("part")).distinct().count()
    return rows if full >= max(slots, wanted) else rows.repartition(max(3 * slots, wanted))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").alias("seq"), F.concat(F.lit("embed-"), "lang").alias("model"), "text", "lang")


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("caller"), F.col("event_type").alias("model"), F.col("props").alias("text"), "value")


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.struct("conv_id", "turn").alias("seq"), F.col("role").alias("model"), "text")


def turn_number(seq: Column) -> Column:
    """A number for the seq of a turn: conv_id * 1000 + turn, and below 0 for turns from 1000 on, which would meet those of the
    next conversation."""
    conv, turn = seq["conv_id"], seq["turn"]
    return F.when(turn < 1000, conv * 1000 + turn).otherwise(-(conv * F.lit(1 << 32) + turn))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq and value: documents as log lines in four envelopes by seq, and junk for every tenth."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", F.col("text").alias("head"))
    body = F.to_json(F.struct(F.concat(F.lit("embed-"), "lang").alias("model"), F.array("head", F.lit("same")).alias("input")))
    single = F.to_json(F.struct(F.concat(F.lit("embed-"), "lang").alias("model"), F.col("head").alias("input")))
    shapes = (
        F.when(F.col("doc_id") % 10 == 9, F.lit("not a request"))
        .when(F.col("doc_id") % 4 == 0, single)
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"level":"info","body":'), body, F.lit("}")))
        .when(F.col("doc_id") % 4 == 2, F.to_json(F.struct(F.lit("t").alias("ts"), single.alias("request"))))
        .otherwise(F.concat(F.lit('{"trace":{"deep":['), body, F.lit("]}}")))
    )
    return docs.select(F.col("doc_id").alias("seq"), shapes.alias("value"))


#: Models of the log of events: three with a price of their own, others without.
MODELS = {"click": "text-embedding-3-small", "view": "text-embedding-3-large", "signup": "text-embedding-ada-002"}


def event_model(kind: Column) -> Column:
    model = kind
    for name, own in MODELS.items():
        model = F.when(kind == name, own).otherwise(model)
    return model


def api_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq and value: events as log lines, by event_id modulo 8: a text; texts with dimensions in an envelope; tokens with an
    encoding, as JSON text in an envelope; token arrays, nested; a parameter in two spellings; a model of a wrong type; an
    empty array; null."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.to_json(F.struct(event_model(F.col("event_type")).alias("m"))).alias("m"), F.to_json(F.struct("props")).alias("t"), (F.col("user_id") % 200).alias("a"), (F.col("event_id") % 7).alias("b"), F.expr("event_id div 8 % 2").alias("odd"))
    bare = lambda c, n: F.expr(f"substring({c}, {n}, length({c}) - {n})")  # noqa: E731  the quoted value of {"name":value}
    events = events.withColumns({"m": bare("m", 6), "t": bare("t", 10)})
    tokens = F.format_string('{"model":%s,"input":[%d,%d],"encoding_format":"base64"}', "m", "a", "b")
    lines = [
        F.format_string('{"model":%s,"input":%s}', "m", "t"),
        F.format_string('{"level":"info","body":{"model":%s,"input":[%s,"same"],"dimensions":256}}', "m", "t"),
        F.to_json(F.struct(tokens.alias("request"), F.lit("t").alias("ts"))),
        F.format_string('{"trace":[{"deep":{"model":%s,"input":[[%d],[%d,%d]],"user":"u"}}]}', "m", "a", "b", "a"),
        F.format_string('{"model":%s,"input":"note %d","temperature":%s}', "m", "b", F.when(F.col("odd") == 1, "1.50").otherwise("1.5")),
        F.format_string('{"model":5,"input":%s}', "t"),
        F.format_string('{"model":%s,"input":[]}', "m"),
        F.format_string('{"model":%s,"input":null,"user":null}', "m"),
    ]
    value = lines[0]
    for k, line in enumerate(lines[1:], 1):
        value = F.when(F.col("seq") % 8 == k, line).otherwise(value)
    return events.select("seq", value.alias("value"))


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, before, after: a sentence is inserted into every twentieth document at the first blank line after a third of
    it, or there where it has none. Every fortieth has blank lines between its lines."""
    text = F.when(F.col("doc_id") % 40 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", text.alias("before"))
    third = F.floor(F.length("before") / 3).cast("int")
    rest = F.substring(F.col("before"), third + 1, F.length("before"))
    docs = docs.withColumn("at", third + F.greatest(F.instr(rest, "\n\n") - 1, F.lit(0)))
    after = F.concat(F.substring(F.col("before"), F.lit(1), F.col("at")), F.lit(SENTENCE), F.substring(F.col("before"), F.col("at") + 1, F.length("before")))
    return docs.select("doc_id", "before", F.when(F.col("doc_id") % 20 == 0, after).otherwise(F.col("before")).alias("after"))
