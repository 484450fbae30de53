"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a key's hash. Every bucket starts as the whole table; only a bucket
over the byte limit is split, on the next bit, until each fits. A bucket of one row is never split, so a row larger
than the limit is a shard of its own. Rows that no bit can tell apart (the same key many times) go on with the bits
of a row number, as overflow pages do, so a key that holds a third of all rows is spread too.

Scale: sizes are aggregated by hash prefix, as many bits at a time as the largest bucket needs, and only prefixes over the
limit are looked at again. The directory is a table (a row for each prefix, a few for each limit's worth of bytes) that
never reaches the driver; it is broadcast while it is measured to be small. Documents are read once for sizes and once for
placement and are not shuffled while it is. The overflow of all keys is split together, in one directory for each key.

Defined results: null text is 0 bytes; a null key hashes as the empty string; an empty table gives no shards; repeated
rows are placed like any others; other columns pass through, also those named like the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import maybe_broadcast, release, stored

STEP = 20  # most bits of the directory that one round of aggregation decides
BITS = 60  # bits of a key's hash: 15 hexadecimal digits
SHARD_BYTES = 64 << 20
QUERY_BYTES = 128 << 10  # limit of the registered query, at which the small test tables fill tens of shards, too


def key_hash(key: Column) -> Column:
    """60-bit hash of a key, null as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _step(largest: int, limit: int, left: int) -> int:
    """Bits that part a bucket of this size into fitting ones, if its keys are even, and two more."""
    return min(left, STEP, (largest // max(limit, 1)).bit_length() + 2)


def directory(sized: DataFrame, limit: int) -> tuple[list[tuple[int, DataFrame, int]], DataFrame]:
    """The directories of all groups `own` over `hash` and `bytes`, as tables (own, entry, depth) with the bits of their entries
    and their numbers of rows, and the (own, entry) of all bits that are still over the limit."""
    part, base, tables = sized, 0, []
    totals = sized.groupBy("own").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    largest = totals.where((F.col("bytes") > limit) & (F.col("n") > 1)).agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0]
    while True:
        upto = base + _step(largest, limit, BITS - base)
        entries = part.groupBy("own", F.shiftright("hash", BITS - upto).alias("entry")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        entries = stored(entries, "shard-entries")
        above = F.expr(f"transform(sequence({base if not base else base + 1}, {upto}), d -> struct(d AS depth, shiftright(entry, {upto} - d) AS prefix))")
        up = entries.select("*", F.explode(above).alias("a")).select("own", "entry", "bytes", "n", "a.*")
        fit = up.groupBy("own", "depth", "prefix").agg(F.sum("bytes").alias("b"), F.sum("n").alias("m")).where(f"b <= {limit} OR m <= 1").select("own", "depth", "prefix")
        placed = stored(up.join(fit, ["own", "depth", "prefix"]).groupBy("own", "entry").agg(F.min("depth").alias("depth")), "shard-directory")
        tables.append((upto, placed, placed.count()))
        over = stored(entries.join(placed, ["own", "entry"], "left_anti"), "shard-over")
        n, largest = over.agg(F.count("*"), F.coalesce(F.max("bytes"), F.lit(0))).first()
        release(entries)
        if not n or upto == BITS:
            return tables, over.select("own", "entry")
        part = part.withColumn("entry", F.shiftright("hash", BITS - upto)).join(maybe_broadcast(over.select("own", "entry"), n, 32), ["own", "entry"], "left_semi").drop("entry")
        base = upto


def _place(rows: DataFrame, tables: list[tuple[int, DataFrame, int]]) -> DataFrame:
    """rows (own, hash) with the depth of their leaf, null where no directory holds them."""
    rows = rows.withColumn("depth", F.lit(None).cast("int"))
    for bits, placed, n in tables:
        one = placed.select("own", "entry", F.col("depth").alias("found"))
        rows = rows.withColumn("entry", F.shiftright("hash", BITS - bits)).join(maybe_broadcast(one, n, 48), ["own", "entry"], "left")
        rows = rows.withColumn("depth", F.coalesce("depth", "found")).drop("entry", "found")
    return rows


def _bits(value: str, depth: str) -> Column:
    return F.expr(f"left(lpad(bin({value}), {BITS}, '0'), {depth})")


def assign(rows: DataFrame, key: Column, size: Column, limit: int = SHARD_BYTES) -> DataFrame:
    """rows with shard (the leaf's bits, then -overflow bits if there are any), depth and row_bytes. Columns of those names
    give way to them."""
    keep = [c for c in rows.columns if c.lower() not in ("shard", "depth", "row_bytes")]
    sized = rows.select(F.lit(0).cast("long").alias("own"), key_hash(key).alias("hash"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"), F.struct(*keep).alias("row"))
    tables, full = directory(sized.select("own", "hash", "bytes"), limit)
    placed = _place(sized, tables)
    named = placed.where("depth IS NOT NULL").withColumn("shard", _bits("hash", "depth"))
    if not full.isEmpty():
        over = stored(placed.where("depth IS NULL").select("hash", "bytes", "row", F.monotonically_increasing_id().alias("number")), "shard-overflow")
        over = over.select(F.col("hash").alias("own"), key_hash(F.col("number")).alias("hash"), "bytes", "row")
        more, _ = directory(over.select("own", "hash", "bytes"), limit)
        over = _place(over, more).withColumn("shard", F.concat(F.lpad(F.bin("own"), BITS, "0"), F.lit("-"), _bits("hash", "depth")))
        named = named.unionByName(over.withColumn("depth", F.col("depth") + BITS))
    return named.select("row.*", "shard", "depth", F.col("bytes").alias("row_bytes"))


def write_shards(rows: DataFrame, path: str, key: Column, size: Column, limit: int = SHARD_BYTES) -> None:
    """One folder for each shard, named `shard=s` and the shard's bits (read as bare bits, 010 and 10 would be one number); no
    shard is larger than the limit, so one task writes each."""
    rows = assign(rows, key, size, limit)
    rows.withColumn("shard", F.concat(F.lit("s"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def op1_sharding(docs: DataFrame, limit: int = QUERY_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes, shard_docs for every document; the key is doc_id."""
    slim = stored(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "shard-sizes")
    placed = stored(assign(slim, F.col("doc_id"), F.col("n_bytes"), limit), "shard-places")
    shards = stored(placed.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs")), "shards")
    release(slim)
    return placed.join(maybe_broadcast(shards, shards.count(), 160), "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def oracle(limit: int = QUERY_BYTES, depth: int = 20) -> str:
    """The same rows, for tables whose directory is no deeper than depth bits."""
    return f"""
WITH sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), levels AS (
  SELECT d.depth, h >> ({BITS} - d.depth) AS prefix, sum(n_bytes) AS b, count(*) AS n
  FROM sized, range(0, {depth + 1}) AS d(depth) GROUP BY ALL
), leaf AS (
  SELECT s.doc_id, s.n_bytes, s.h, min(l.depth) AS depth
  FROM sized s JOIN levels l ON s.h >> ({BITS} - l.depth) = l.prefix AND (l.b <= {limit} OR l.n <= 1)
  GROUP BY ALL
), named AS (
  SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h), {BITS}, '0'), {BITS}) [1:depth] END AS shard
  FROM leaf
)
SELECT doc_id, n_bytes, shard, CAST(depth AS INTEGER) AS depth,
       CAST(sum(n_bytes) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes, count(*) OVER (PARTITION BY shard) AS shard_docs
FROM named
"""
