"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame expressions only.

A test item is found in a document if at least THRESHOLD of the item's distinct word shingles are shingles of the document,
however long the document is. Items are partitioned by size (powers of two of their number of shingles). The MinHash
sketch of an item is its smallest shingle hashes; a partition of items of at most u shingles keeps twice
u - ceil(THRESHOLD * u) + 1. A document that holds THRESHOLD of an item misses fewer of its shingles than half of that,
so it must hold all the others of the sketch: those that hold fewer are no candidates, and the search loses nothing. A
document looks only in partitions small enough for it to contain an item of theirs. Candidates are verified by exact
containment of the shingles' texts.

Words are runs of letters and digits in lower case, so that case and punctuation do not hide a copy; shingles have five
words. An item of fewer words is one shingle, and is looked for among the documents' shingles of that many words.

Scale: a document's shingles of all widths are hashed in one pass, where it is read; only those that meet a sketch go on,
and are counted before the shuffle. Sketches, items and candidates are broadcast when they are measured to be small, and
joined by shuffle otherwise.

Defined results: null, empty and wordless texts contain and are contained in nothing; rows with equal ids are verified
one by one and reported once, with the highest containment; null ids are reported as null; empty tables give no rows;
other columns are ignored by the query and kept by the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import NOT_ALNUM, maybe_broadcast, numbered, stored, without_rows
from lodestone.sources.tables import spread

WIDTH = 5
THRESHOLD = 0.8


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{NOT_ALNUM}]+"), "")


def _shingles(items: str, width: int, of: str) -> Column:
    """For each run of width elements of the array named items: the SQL expression `of` over the position i (from 0)."""
    return F.expr(f"CASE WHEN size({items}) >= {width} THEN array_distinct(transform(sequence(0, size({items}) - {width}), i -> {of})) ELSE array() END")


def _hashes(width: int) -> Column:
    """Distinct 64-bit hashes of the shingles over `_word_hashes`."""
    return _shingles("_word_hashes", width, f"xxhash64({', '.join(f'_word_hashes[i + {k}]' for k in range(width))})")


def _texts(width: int) -> Column:
    """Distinct shingles over `_words`, as texts."""
    return _shingles("_words", width, f"array_join(slice(_words, i + 1, {width}), ' ')")


def _with_word_hashes(df: DataFrame) -> DataFrame:
    return df.withColumn("_word_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def _items(items: DataFrame, item_id: Column, text: Column, threshold: float) -> DataFrame:
    """A row for each item with words: item_id, width, n_item, need, its shingles as texts and its sketch."""
    own = _with_word_hashes(items.select(item_id.alias("item_id"), words(text).alias("_words")))
    own = stored(own.withColumn("width", F.least(F.size("_words"), F.lit(WIDTH))), "item-words").where("width > 0")
    by_width = lambda make: F.coalesce(*[F.when(F.col("width") == w, make(w)) for w in range(1, WIDTH + 1)])
    own = own.select("item_id", "width", by_width(_hashes).alias("hashes"), by_width(_texts).alias("shingles"))
    own = own.withColumns({"n_item": F.size("shingles"), "need": F.ceil(F.lit(threshold) * F.size("shingles")).cast("int")})
    own = own.withColumn("part", F.floor(F.log2("n_item")).cast("int"))
    bounds = own.groupBy("part").agg(F.max("n_item").alias("most"), F.min("need").alias("part_need"))
    depth = 2 * (F.col("most") - F.ceil(F.lit(threshold) * F.col("most")).cast("int") + 1)
    own = own.join(bounds, "part").withColumn("sketch", F.slice(F.sort_array("hashes"), F.lit(1), depth))
    return own.withColumn("hits", F.size("sketch") - (F.col("n_item") - F.col("need"))).drop("hashes", "most")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, containment, n_shared, n_item for every document and item with containment >= threshold."""
    own = stored(_items(items, F.col("item_id"), F.col("text"), threshold), "items")
    n_items, n_bytes, n_sketch = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("shingles", "----"))), F.lit(0)), F.coalesce(F.sum(F.size("sketch")), F.lit(0))).first()
    widths = sorted(r.width for r in own.select("width").distinct().limit(WIDTH).collect()) or [WIDTH]
    sketches = own.select("item_id", "width", "part_need", "hits", F.explode("sketch").alias("hash"))
    sketches = maybe_broadcast(sketches, n_sketch, 64)

    texts = spread(docs.select(F.col("doc_id"), F.col("text").alias("_text")))
    read = _with_word_hashes(texts.select("doc_id", words(F.col("_text")).alias("_words"))).select("doc_id", *[_hashes(w).alias(f"_of_{w}") for w in widths])
    probes = [F.expr(f"transform(_of_{w}, h -> struct({w} AS width, size(_of_{w}) AS n_doc, h AS hash))") for w in widths]
    # explode_outer: explode() would add a filter on the array, and with it a second evaluation of all that makes it.
    if len(widths) == 1:
        probes = read.select("doc_id", F.lit(widths[0]).alias("width"), F.size(f"_of_{widths[0]}").alias("n_doc"), F.explode_outer(f"_of_{widths[0]}").alias("hash"))
    else:
        probes = read.select("doc_id", F.explode_outer(F.concat(*probes)).alias("_p")).select("doc_id", "_p.*")
    met = probes.join(sketches, ["hash", "width"]).where(F.col("n_doc") >= F.col("part_need"))
    met = met.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.min("hits").alias("hits")).where("n >= hits")
    candidates = stored(met.select("doc_id", "item_id"), "decontaminate-candidates")
    n_candidates = candidates.count()

    ids = maybe_broadcast(candidates.select(F.col("doc_id").alias("_id")).distinct(), n_candidates, 32)
    held = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("doc_id", words(F.col("_text")).alias("_words"))
    held = held.select("doc_id", *[_texts(w).alias(f"_of_{w}") for w in widths])
    pairs = maybe_broadcast(candidates.withColumnRenamed("doc_id", "_id"), n_candidates, 48)
    pairs = held.join(pairs, F.col("doc_id").eqNullSafe(F.col("_id")))
    wanted = maybe_broadcast(own.select(F.col("item_id").alias("_item"), "width", "n_item", "need", "shingles"), 1, 64 * n_items + n_bytes)
    pairs = pairs.join(wanted, F.col("item_id").eqNullSafe(F.col("_item")))
    of_width = F.coalesce(*[F.when(F.col("width") == w, F.col(f"_of_{w}")) for w in widths])
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect(of_width, "shingles"))).where("n_shared >= need")
    best = pairs.withColumn("containment", F.col("n_shared") / F.col("n_item")).groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.containment", F.col("best.n_shared").cast("long").alias("n_shared"), F.col("best.n_item").cast("long").alias("n_item"))


def op8_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contained(docs, benchmark)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that contain an item of the benchmark, decided row by row whatever their ids."""
    rows, (file, at) = numbered(docs)
    found = contained(rows.select(F.struct(F.col(file).alias("file"), F.col(at).alias("at")).alias("doc_id"), "text"), benchmark)
    leaks = stored(found.select("doc_id").distinct().select("doc_id.*"), "leaks")
    return without_rows(rows, [file, at], leaks).select(*docs.columns)


ORACLE_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc_words)
), item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words)
), sizes AS (
  SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id
), shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (s) GROUP BY ALL
)
SELECT doc_id, item_id, n_shared / n_item AS containment, n_shared, n_item
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= ceil(0.8 * n_item)
"""
