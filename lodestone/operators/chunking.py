"""Chunking: content-defined, fixed-size, by delimiter and by paragraph; differences between versions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chunk sizes in bytes (least, average, most) and how many bits either mask departs from the average's.
LEAST, AVERAGE, MOST, LEVEL = 200, 800, 2000, 2

CHUNKS = "array<struct<ordinal:int,offset:bigint,size:int,data:binary,hash:string>>"
PLACES = "array<struct<ordinal:int,offset:bigint,size:int,hash:string>>"


def options(least: int = 0, average: int = 0, most: int = 0) -> tuple[int, int, int]:
    """Sizes with defaults for what is not positive, made consistent: least <= average <= most."""
    least, average, most = least if least > 0 else LEAST, average if average > 0 else AVERAGE, most if most > 0 else MOST
    least = min(least, most)
    return least, min(max(average, least), most), most


def _table() -> np.ndarray:
    """The rolling hash's value of each byte: the first eight bytes of its SHA-256, the lowest first."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


class Cutter:
    """Cut points by a shift-and-add rolling hash under two low-bit masks.

    The hash only shifts left, so its low n bits depend on the last n bytes alone: all positions' hashes are n shifted sums
    of one table lookup, and a chunk's start matters only for its first n bytes, which are hashed from the chunk's own."""

    def __init__(self, least: int = 0, average: int = 0, most: int = 0) -> None:
        self.least, self.average, self.most = options(least, average, most)
        bits = self.average.bit_length() - 1
        self.strict, self.loose = (1 << (bits + LEVEL)) - 1, (1 << max(0, bits - LEVEL)) - 1
        self.window = bits + LEVEL
        self.values = (_table() & np.uint64(self.strict)).astype(np.int64)

    def _hashes(self, values: np.ndarray) -> np.ndarray:
        """The hash after each byte, from the first of these on."""
        out = np.zeros(len(values), np.int64)
        for k in range(min(self.window, len(values))):
            out[k:] += values[: len(values) - k] << k
        return out & self.strict

    def cuts(self, data: bytes) -> list[int]:
        """Ends of the chunks of data."""
        values = self.values[np.frombuffer(data, np.uint8)]
        full = self._hashes(values)
        ends, at, n = [], 0, len(data)
        strict, loose = np.flatnonzero(full == 0), np.flatnonzero(full & self.loose == 0)
        while at < n:
            if n - at <= self.least:
                ends.append(n)
                break
            stop = min(n, at + self.most)
            first, center = at + self.least, min(at + self.average, stop)
            warm = min(first + self.window, stop)
            own = self._hashes(values[first:warm])
            cut = stop
            for mask, low, high, places in ((self.strict, first, center, strict), (self.loose, center, stop, loose)):
                hit = np.flatnonzero(own[max(0, low - first) : max(0, min(high, warm) - first)] & mask == 0)
                if len(hit):
                    cut = max(low, first) + int(hit[0]) + 1
                    break
                k = np.searchsorted(places, max(low, warm))
                if k < len(places) and places[k] < high:
                    cut = int(places[k]) + 1
                    break
            ends.append(cut)
            at = cut
        return ends

    def places(self, data: bytes) -> list[tuple[int, int, int, str]]:
        """Ordinal, offset, size and hash of each chunk."""
        ends, view = self.cuts(data), memoryview(data)
        return [(k, a, b - a, hashlib.sha256(view[a:b]).hexdigest()) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]

    def split(self, data: bytes) -> list[dict]:
        ends = self.cuts(data)
        return [{"ordinal": k, "offset": a, "size": b - a, "data": data[a:b], "hash": hashlib.sha256(data[a:b]).hexdigest()} for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]


#: Texts whose chunks are held in Python at once.
AT_ONCE = 64

_PLACES = pa.struct([("ordinal", pa.int32()), ("offset", pa.int64()), ("size", pa.int32()), ("hash", pa.string())])


def place_batches(least: int = 0, average: int = 0, most: int = 0):
    """The chunks' places of batches of texts or bytes. A batch stays an Arrow buffer, of which AT_ONCE texts at a time are read and
    given back, so that a worker's memory does not grow with the batches."""
    cutter = Cutter(least, average, most)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for k in range(0, max(1, len(batch)), AT_ONCE):
                own = batch.slice(k, AT_ONCE).cast(pa.binary()).to_pylist()
                cut = [[] if d is None else cutter.places(d) for d in own]
                ends = np.cumsum([0, *map(len, cut)])
                columns = zip(*(c for own in cut for c in own), strict=True) if ends[-1] else [[]] * len(_PLACES)
                flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLACES, strict=True)], fields=list(_PLACES))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return run


def content_chunks(text: Column, least: int = 0, average: int = 0, most: int = 0, data: bool = False) -> Column:
    """The content-defined chunks of a text or of bytes, as arrays of (ordinal, offset, size, hash); none for nothing. With
    `data`, their bytes too, which are cut out of the text where it is and do not come back from Python."""
    run = place_batches(least, average, most)
    whole = F.when(text.isNotNull(), text.cast("binary"))
    places = F.arrow_udf(run, PLACES).asNondeterministic()(whole)  # so that filters on the chunks do not cut the texts once more
    if not data:
        return places
    return F.transform(places, lambda c: F.struct(c["ordinal"].alias("ordinal"), c["offset"].alias("offset"), c["size"].alias("size"), F.substring(whole, (c["offset"] + 1).cast("int"), c["size"]).alias("data"), c["hash"].alias("hash")))


def fixed_chunks(text: Column, size: int = AVERAGE) -> Column:
    """Slices of `size` bytes: arrays of (ordinal, offset, size, data, hash)."""
    data = text.cast("binary")
    n = F.octet_length(data)

    def part(k: Column) -> Column:
        piece = F.substring(data, k * size + 1, F.lit(size))
        return F.struct(k.cast("int").alias("ordinal"), (k * size).cast("bigint").alias("offset"), F.octet_length(piece).alias("size"), piece.alias("data"), F.sha2(piece, 256).alias("hash"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), part)).otherwise(F.array().cast(CHUNKS))


def exploded(rows: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(chunks).alias("_c")).select(*keep, "_c.*")


def line(hash_: Column, size: Column, data: Column) -> Column:
    """A chunk as a JSON line of hash, size and text. A chunk may begin or end within a character; such bytes read as
    replacement marks."""
    return F.to_json(F.struct(hash_.alias("hash"), size.alias("size"), F.validate_utf8(F.make_valid_utf8(data.cast("string"))).alias("text")))


def chunk_json(chunks: DataFrame) -> DataFrame:
    """JSON lines of chunks."""
    return chunks.select(line(F.col("hash"), F.col("size"), F.col("data")).alias("value"))


def difference(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Chunks of the new version: all, unchanged (their hash was there before) and changed. Counts chunks, not hashes."""
    by = by or []
    known = before.select(*by, "hash").distinct().withColumn("_old", F.lit(True))
    rows = after.join(known, [*by, "hash"], "left")
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("_old")).alias("unchanged"), F.count_if(F.col("_old").isNull()).alias("changed"))


def difference_of(rows: DataFrame, *keep: str) -> DataFrame:
    """The same for versions whose chunks stand in one row (before, after): counted there, without a join."""
    hashes = F.transform("before", lambda c: c["hash"])
    old = F.map_from_arrays(F.array_distinct(hashes), F.transform(F.array_distinct(hashes), lambda h: F.lit(True)))
    known = F.aggregate("after", F.lit(0).cast("bigint"), lambda n, c: n + F.when(F.map_contains_key(F.col("_old"), c["hash"]), 1).otherwise(0))
    counted = rows.withColumn("_old", old).select(*keep, F.size("after").cast("long").alias("total"), known.alias("unchanged")).where("total > 0")
    return counted.withColumn("changed", F.col("total") - F.col("unchanged"))


def delimited(text: Column, delimiter: str, least: int = 80, most: int = 1200) -> Column:
    """Parts between delimiters of at least `least` bytes, cut to `most` characters; each but the first keeps its delimiter's
    last word."""
    parts = F.transform(F.split(text, _literal(delimiter)), lambda p: F.trim(p))
    return F.transform(F.filter(parts, lambda p: F.octet_length(p) >= least), lambda p: F.substring(p, 1, most))


def _literal(s: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in s)


def paragraphs(text: Column, least: int = 120, most: int = 600) -> Column:
    """Paragraphs long enough, without headings (==), cut to `most` characters."""
    parts = F.transform(F.split(text, "\n"), lambda p: F.trim(p))
    return F.transform(F.filter(parts, lambda p: (F.octet_length(p) >= least) & ~p.startswith("==")), lambda p: F.substring(p, 1, most))


def pack(text: str, budget: int = 500, full: int = 300, least: int = 150, soft: int = 250) -> list[str]:
    """Paragraphs packed into chunks: pieces of at most `budget` bytes, cut at the last space if that is at `soft` or beyond; a
    chunk closes when it holds `full` bytes or the next piece would pass the budget; chunks under `least` bytes are dropped."""
    done: list[bytes] = []
    held = b""

    def close() -> None:
        nonlocal held
        if len(held) >= least:
            done.append(held.strip())
        held = b""

    for paragraph in text.split("\n"):
        rest = paragraph.strip().encode()
        if rest.startswith(b"=="):
            continue
        while rest:
            at = len(rest)
            if at > budget:
                space = rest.rfind(b" ", 0, budget)
                at = space if space >= soft else budget
            piece, rest = rest[:at], rest[at:].strip()
            if len(held) + len(piece) > budget:
                close()
            held += b" " + piece if held else piece
            if len(held) >= full:
                close()
    close()
    return [c.decode("utf-8", "replace") for c in done]


@F.pandas_udf(T.ArrayType(T.StringType()))
def packed_paragraphs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: pack(t) if isinstance(t, str) else [])
