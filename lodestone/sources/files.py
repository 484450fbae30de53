"""Small reference files: prices, budgets, key lists, retrieval collections, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import trim


def _named_numbers(spark: SparkSession, path: str, value: str) -> tuple[DataFrame, float | None]:
    """A JSON object of names and numbers as rows, without the entry `default` in any case, whose number is returned."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,double>")).alias("name", value))
    is_default = F.lower("name") == "default"
    default = rows.where(is_default).first()
    return rows.where(~is_default), default[value] if default else None


def read_prices(spark: SparkSession, path: str) -> tuple[DataFrame, float | None]:
    """(model, price) and the default price, if the file names one."""
    rows, default = _named_numbers(spark, path, "price")
    return rows.withColumnRenamed("name", "model"), default


def read_budgets(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    """(caller, token_limit) and the default limit, if the file names one."""
    rows, default = _named_numbers(spark, path, "token_limit")
    return rows.select(F.col("name").alias("caller"), F.col("token_limit").cast("long")), None if default is None else int(default)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a file, one a line; blank lines and comments (#) are left out."""
    rows = spark.read.text(path).select(trim(F.col("value")).alias("key"))
    return rows.where((F.col("key") != "") & ~F.col("key").startswith("#"))


def keys_from_list(spark: SparkSession, text: str) -> DataFrame:
    """Keys of a comma-separated list."""
    found = [(k.strip(),) for k in text.split(",") if k.strip()]
    return spark.createDataFrame(found, "key string")


def read_corpus(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(id, text) of a retrieval corpus: title and text joined by a full stop, trimmed; the first `most` by id, if given."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    if most is not None:
        rows = rows.orderBy("_id").limit(most)
    return rows.select(F.col("_id").alias("id"), F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit("")))).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("id"), "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance) of a tab-separated file with a header."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    q, d, s = rows.columns[:3]
    return rows.select(F.col(q).alias("query_id"), F.col(d).alias("doc_id"), F.col(s).cast("int").alias("relevance"))


CACHE = T.StructType([T.StructField("key", T.StringType()), T.StructField("raw", T.BinaryType()), T.StructField("tokens", T.LongType()), T.StructField("expires_at", T.LongType())])


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> str | None:
    """The newest whole version of a snapshot."""
    place, fs = _file_system(spark, path)
    if not fs.exists(place):
        return None
    versions = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith("version="))
    whole = [v for v in versions if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS"))]
    return f"{path}/{whole[-1]}" if whole else None


def write_snapshot(cache: DataFrame, path: str, keep: int = 2) -> str:
    """Writes a new version beside the ones that are there, which stays unseen until it is whole, so a cache may be read from
    the very snapshot that it is written to. Versions but the last `keep` are removed. Returns the version's folder."""
    spark = cache.sparkSession
    now = _current(spark, path)
    n = int(now.rpartition("=")[2]) + 1 if now else 0
    out = f"{path}/version={n:09d}"
    cache.select(*CACHE.names).write.mode("overwrite").parquet(out)
    place, fs = _file_system(spark, path)
    for old in sorted(s.getPath().getName() for s in fs.listStatus(place))[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return out


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a cache snapshot; an empty one where there is none."""
    now = _current(spark, path)
    return spark.createDataFrame([], CACHE) if now is None else spark.read.schema(CACHE).parquet(now)
