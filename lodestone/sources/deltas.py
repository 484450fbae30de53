"""Keyed tables that grow by deltas: each commit writes only its own rows, and a manifest names the deltas that count.

A delta is a folder of Parquet files and a filter: the bits of a Bloom filter over its keys, as a table of words of 64 bits.
Manifests are numbered; the newest one counts, and it is put in place by renaming a finished file, so a reader sees a commit whole or
not at all. A commit that carries the number of a stream's batch is made once, however often the batch is tried. Readers take
the union of the deltas. A lookup reads only the deltas whose filter may hold one of the keys, and of those only what is asked.
Deltas of like size are merged once there are FAN of them, so a table of n rows has about FAN * log(n) deltas and a row is written
about log(n) times. One writer at a time is assumed; two would need a rename that fails where a file is, which not every store has."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import if_small, new_place, stored

FAN = 8
BITS_PER_KEY, HASHES = 12, 4  # of the filters: one in 300 keys that a delta does not hold passes
KEEP = 3  # manifests that stay


def _bits(key: Column, size: Column | int) -> Column:
    """The bits of a key, as an array of (word, bit)."""
    size = F.lit(size).cast("long") if isinstance(size, int) else size
    places = [F.pmod(F.xxhash64(F.lit(k), key), size) for k in range(HASHES)]
    return F.array(*[F.struct(F.shiftright(p, 6).alias("word"), F.pmod(p, F.lit(64)).cast("int").alias("bit")) for p in places])


class DeltaTable:
    """A table at a path, told apart by its column `key`."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # --- manifests ---

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        place, fs = self._fs(f"{self.path}/_manifests")
        if not fs.exists(place):
            return []
        return sorted(name for s in fs.listStatus(place) if (name := s.getPath().getName()).endswith(".json"))

    def manifest(self) -> dict:
        """The newest manifest: its number, the deltas {name, rows, bits, level} and the numbers of batches that are in."""
        names = self._manifests()
        if not names:
            return {"version": 0, "deltas": [], "batches": {}, "schema": None}
        place, fs = self._fs(f"{self.path}/_manifests/{names[-1]}")
        stream = fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        manifest = manifest | {"version": manifest["version"] + 1}
        name = f"{manifest['version']:012d}.json"
        draft, fs = self._fs(f"{self.path}/_manifests/.{name}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not fs.rename(draft, self._fs(f"{self.path}/_manifests/{name}")[0]):
            raise RuntimeError(f"another writer has made version {manifest['version']} of {self.path}")
        for old in self._manifests()[:-KEEP]:
            fs.delete(self._fs(f"{self.path}/_manifests/{old}")[0], False)

    # --- writing ---

    def _write(self, rows: DataFrame, level: int) -> dict | None:
        """One delta; None if there are no rows."""
        name = new_place(self.spark, "delta").rpartition("/")[2]
        rows.write.parquet(f"{self.path}/{name}/rows")
        held = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/rows")
        n = held.count()
        if not n:
            return None
        size = 1 << max(10, math.ceil(math.log2(BITS_PER_KEY * n)))
        words = held.select(F.explode(_bits(F.col(self.key), size)).alias("b")).groupBy("b.word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b.bit"))).alias("bits"))
        words.write.parquet(f"{self.path}/{name}/filter")
        return {"name": name, "rows": n, "bits": size, "level": level}

    def commit(self, rows: DataFrame, batch: int | None = None, writer: str = "") -> bool:
        """Adds rows as a delta. With the number of a batch, only if the writer's batches so far are smaller; says whether it did."""
        now = self.manifest()
        if batch is not None and now["batches"].get(writer, -1) >= batch:
            return False
        delta = self._write(rows, 0)
        batches = now["batches"] | ({writer: batch} if batch is not None else {})
        self._publish(now | {"deltas": now["deltas"] + ([delta] if delta else []), "batches": batches, "schema": rows.schema.json()})
        return True

    def replace(self, rows: DataFrame, batch: int | None = None, writer: str = "") -> bool:
        """Makes rows the table's only delta; with the number of a batch, as in commit. rows may be read from the table."""
        now = self.manifest()
        if batch is not None and now["batches"].get(writer, -1) >= batch:
            return False
        delta = self._write(rows, 0)
        batches = now["batches"] | ({writer: batch} if batch is not None else {})
        self._publish(now | {"deltas": [delta] if delta else [], "batches": batches, "schema": rows.schema.json()})
        self._clean(self.manifest())
        return True

    def compact(self, merge: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Merges deltas of a level once there are FAN of them, into one of the next; `merge` may combine rows of a key. The
        merged folders are removed with the manifests that name them. Returns the merges made."""
        made = 0
        while True:
            now = self.manifest()
            levels: dict[int, list[dict]] = {}
            for d in now["deltas"]:
                levels.setdefault(d["level"], []).append(d)
            full = next((own for _, own in sorted(levels.items()) if len(own) >= FAN), None)
            if full is None:
                self._clean(now)
                return made
            rows = self._rows(full)
            merged = self._write(rows if merge is None else merge(rows), full[0]["level"] + 1)
            names = {d["name"] for d in full}
            self._publish(now | {"deltas": [d for d in now["deltas"] if d["name"] not in names] + ([merged] if merged else [])})
            made += 1

    def _clean(self, now: dict) -> None:
        """Removes folders that none of the kept manifests names."""
        used = {d["name"] for d in now["deltas"]}
        for name in self._manifests():
            place, fs = self._fs(f"{self.path}/_manifests/{name}")
            stream = fs.open(place)
            used |= {d["name"] for d in json.loads(bytes(stream.readAllBytes()).decode())["deltas"]}
            stream.close()
        place, fs = self._fs(self.path)
        if fs.exists(place):
            for s in fs.listStatus(place):
                name = s.getPath().getName()
                if name.startswith("delta-") and name not in used:
                    fs.delete(s.getPath(), True)

    # --- reading ---

    def _schema(self, now: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(now["schema"]))

    def _rows(self, deltas: list[dict]) -> DataFrame:
        return self.spark.read.schema(self._schema(self.manifest())).parquet(*[f"{self.path}/{d['name']}/rows" for d in deltas])

    def read(self, schema: str | None = None) -> DataFrame:
        """All rows; of a table without commits, none, with the given schema."""
        now = self.manifest()
        if not now["deltas"]:
            return self.spark.createDataFrame([], self._schema(now) if now["schema"] else schema)
        return self._rows(now["deltas"])

    def may_hold(self, keys: DataFrame) -> list[dict]:
        """The deltas whose filter holds all bits of at least one of the keys."""
        deltas = self.manifest()["deltas"]
        if not deltas:
            return []
        asked = keys.select(F.col(self.key).alias("k")).distinct()
        asked = stored(asked, "asked-keys")
        n = asked.count()
        out = []
        for size in sorted({d["bits"] for d in deltas}):  # a job for each size of filter, of which there are few
            own = [d for d in deltas if d["bits"] == size]
            held = None
            for d in own:
                words = self.spark.read.schema("word long, bits long").parquet(f"{self.path}/{d['name']}/filter").withColumn("delta", F.lit(d["name"]))
                held = words if held is None else held.unionByName(words)
            bits = asked.select("k", F.explode(_bits(F.col("k"), size)).alias("b")).select("k", "b.word", "b.bit")
            met = held.join(if_small(bits, HASHES * n, 64), "word").where(F.getbit("bits", "bit") == 1)
            full = met.groupBy("delta", "k").agg(F.count_distinct("word", "bit").alias("n"))
            need = bits.groupBy("k").agg(F.count_distinct("word", "bit").alias("need"))
            hits = full.join(need, "k").where("n = need").select("delta").distinct()
            names = {r.delta for r in hits.collect()}  # names of deltas
            out += [d for d in own if d["name"] in names]
        return out

    def missing(self, rows: DataFrame) -> DataFrame:
        """Those rows whose key the table does not hold; only deltas that may hold one are read, and only their keys."""
        deltas = self.may_hold(rows)
        if not deltas:
            return rows
        return rows.join(self._rows(deltas).select(self.key), self.key, "left_anti")
