"""Deduplication, counters and expiry over unbounded input."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.cost import cost
from lodestone.operators import heavy
from lodestone.sources import files
from lodestone.sources.deltas import DeltaTable
from lodestone.sources.shared import release, shared_dir, stored


def unique() -> str:
    return uuid.uuid4().hex


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a growing folder of logs."""
    return spark.readStream.text(path).where(F.regexp_replace("value", r"\s+", "") != "")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        folder, _, name = path.rpartition("/")
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def first_seen(items: DataFrame, at: str | None = None, delay: str | None = None) -> DataFrame:
    """The first item of each key. With an event time and a delay, state is kept within the watermark only."""
    if at and delay:
        return items.withWatermark(at, delay).dropDuplicatesWithinWatermark(["key"])
    return items.dropDuplicates(["key"])


def running_usage(items: DataFrame, by: str) -> DataFrame:
    """Live counters (complete or update mode): items, tokens and money by a column."""
    return items.groupBy(by).agg(F.count("*").alias("items"), F.sum("est_tokens").alias("tokens")).withColumn("usd", cost(F.col(by), F.col("tokens")))


def windowed_spending(items: DataFrame, at: str, seconds: int, delay: str, by: str = "caller") -> DataFrame:
    """Tokens by caller and fixed window, final once the watermark has passed."""
    return items.withWatermark(at, delay).groupBy(by, F.window(at, f"{seconds} seconds")).agg(F.sum("est_tokens").alias("tokens"))


def expiring(items: DataFrame, ttl_ms: int, at: str = "at", delay: str = "1 day") -> DataFrame:
    """items (key, seq, t_ms, at: the same time as a timestamp) with hit: entries live ttl_ms from computation. The state is one
    time for each key, and it goes once the watermark, `delay` behind the latest event, has passed the entry's end: a later
    item of the key is a miss with or without it. So state holds the keys of a ttl and a delay, however long the stream is.
    Items later than the watermark are dropped. A micro-batch of a key is sorted in one piece; bound batches at their source."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t_ms", "seq"])
        hits = []
        for t in rows["t_ms"]:
            hit = since is not None and t <= since + ttl_ms
            since = since if hit else int(t)
            hits.append(hit)
        end = since + ttl_ms + 1
        if end > state.getCurrentWatermarkMs():
            state.update((since,))
            state.setTimeoutTimestamp(end)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"], "hit": hits})

    own = items.withWatermark(at, delay).groupBy("key")
    return own.applyInPandasWithState(run, "key string, seq long, hit boolean", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def append_new(items: DataFrame, path: str, checkpoint: str):
    """A query that appends each micro-batch's keys that the delta table at path does not hold yet: write-through to a shared
    tier. A batch reads the deltas whose filter may hold one of its keys, and writes only what is new; one that is tried again
    is written once."""

    def write(batch: DataFrame, number: int) -> None:
        table = DeltaTable(batch.sparkSession, path)
        new = stored(batch.where("key IS NOT NULL").dropDuplicates(["key"]), "batch")
        table.commit(table.missing(new), number, checkpoint)
        table.compact()
        release(new)

    return items.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def heavy_keys(items: DataFrame, path: str, checkpoint: str, most: int):
    """A query that keeps a sketch of the heaviest keys of items (key, est_tokens) at path: each micro-batch's sketch is merged into
    it, so what is kept has `most` rows however long the stream is."""

    def write(batch: DataFrame, number: int) -> None:
        table = DeltaTable(batch.sparkSession, path)
        if table.manifest()["batches"].get(checkpoint, -1) >= number:
            return
        own = heavy.sketch(batch, "key", "est_tokens", most)
        table.replace(heavy.merged(table.read(heavy.SKETCH).unionByName(own), most), number, checkpoint)

    return items.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def tier(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The shared tier that append_new and snapshots write."""
    return DeltaTable(spark, path).read(schema)


def snapshots(entries: DataFrame, path: str, checkpoint: str):
    """A query that keeps a snapshot of the cache at path up to date: a micro-batch adds those of its entries (key, raw, tokens,
    expires_at) whose keys the snapshot does not hold. What was committed last is whole, whenever the query stops."""
    return append_new(entries.select(*files.CACHE.names), path, checkpoint)


class LiveCounters(StreamingQueryListener):
    """The measures of a report over streams that observe them under a name, added up as their micro-batches end. Register it with
    spark.streams.addListener; `totals` may be read at any time."""

    def __init__(self, name: str = "ledger") -> None:
        self.name, self.totals = name, {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802  names of the interface
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        seen = event.progress.observedMetrics.get(self.name)
        for name, value in (seen.asDict() if seen is not None else {}).items():
            self.totals[name] = self.totals.get(name, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def drained(stream: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """What a stream gives for the input that is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
