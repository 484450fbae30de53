"""Shared pieces of the training-data operators: tables, stored intermediates, text expressions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import new_place, release, shared_dir, stored  # noqa: F401  the operators' names for them

#: Byte classes of the word definitions, as regular expression classes.
SPACES = r"\x20\x09-\x0D"
NOT_ALNUM = r"\x00-\x2F\x3A-\x60\x7B-\x7F"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Largest table, in bytes, that an operator hints to broadcast after measuring it.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where df has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if n.lower() not in taken) for name in names]


def _scanned(df: DataFrame) -> bool:
    """Whether df is a scan of Parquet files with columns chosen or computed: only these tell each row's place in its file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation" or "_metadata" in df.columns:
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with two columns that tell its rows apart, whichever tasks read them and however often: a hash of the file's path
    and the row's place in it. What is no scan of Parquet files is stored first, since its rows have no place that can be told."""
    names = fresh(df, *(names or ("_file", "_at")))
    if not _scanned(df):
        df = stored(df, "rows")
    return df.select("*", F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names


def without_rows(rows: DataFrame, names: list[str], dropped: DataFrame) -> DataFrame:
    """numbered() rows without the dropped ones (file, at). While these are measured to be few they are broadcast; beyond that, a
    bitmap for each input file is written to the shared folder, and the task that reads a file looks its rows up in that
    file's. Either way rows stay where they are read, however many are dropped."""
    file, at = names
    n = dropped.count()
    few = maybe_broadcast(dropped.toDF(file, at), n, 32)
    if n * 32 <= BROADCAST_BYTES:
        return rows.join(few, [file, at], "left_anti")
    path = new_place(rows.sparkSession, "dropped")
    own = dropped.toDF("file", "at").select("file", (F.col("at") + 1).alias("at"))  # places in bitmaps begin at 1
    bits = own.groupBy("file", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits.repartition("file").write.partitionBy("file").parquet(path)
    from lodestone.llm.dropped import bit_reader  # it needs pandas, which other workers need not load

    return rows.where(bit_reader(path)(F.col(file), F.col(at)))


def dealt(df: DataFrame) -> DataFrame:
    """Few rows with much to do for each, dealt out to all tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: A key of more rows than this, and than a 100,000th of all, is joined apart.
HOT_ROWS = 4096


def join_spread(rows: DataFrame, table: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows joined with a table of one row for each key. Keys of very many rows, at most 100,000, are joined by broadcast, so
    that none gathers in one task."""
    least = max(HOT_ROWS, n_rows // 100_000)
    hot = stored(rows.groupBy(key).count().where(F.col("count") > least).select(F.col(key).alias("_hot")), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, key)
    few = table.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left_semi")
    rest = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left_anti").join(table, key)
    return rows.join(F.broadcast(stored(few, "hot-rows")), key).unionByName(rest)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, _UPPER, _UPPER.lower())


def count_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    marks = F.regexp_replace(
        F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{SPACES}]+", ""),
        rf"[^{SPACES}]++[{SPACES}]*+",
        "x",
    )
    return F.octet_length(marks).cast("long")


def maybe_broadcast(df: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only while n_rows * row_bytes stays under BROADCAST_BYTES; else leave a shuffle join."""
    return F.broadcast(df) if n_rows * row_bytes <= BROADCAST_BYTES else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> Iterator[None]:
    """Jobs that run within hand texts to Python in batches of at most so many rows and bytes, so that neither a task nor its
    worker holds more than a few of them at once."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def give_back_memory() -> None:
    """Returns what a worker process has freed to the system; workers live on, and the next task may be another's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text."""
    step = "list_reduce([xor(c, b)] || range(8), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(ascii(substr({text}, k, 1)) AS BIGINT))"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {codes}, lambda c, b: {step}), 4294967295)"
