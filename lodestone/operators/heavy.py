"""Heavy keys by mergeable counters, exact by a second pass.

A sketch keeps `most` counters and the error that they may be short of: what all counters were lowered by, together, whenever there
were more keys than counters. A key's weight lies between its counter (0 without one) and the counter plus the error, and the
error is at most the whole weight divided by `most` + 1. Sketches of parts add up: counters are summed and lowered again, errors
are summed. So a stream or any number of tasks keep `most` rows each.

The heaviest keys are exact: weights of the keys that have counters are counted in a second pass, and no other key weighs more
than the error; if the last one reported weighs less than that, the search is done again with more counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import ledger
from lodestone.sources.shared import if_small, stored

SKETCH = "key string, weight long, error long"  # the error is held by a row without key


class Counters:
    def __init__(self, most: int) -> None:
        self.most, self.weights, self.error = most, {}, 0

    def add(self, keys: list, weights: np.ndarray) -> None:
        for key, weight in zip(keys, weights.tolist(), strict=True):
            self.weights[key] = self.weights.get(key, 0) + weight
        if len(self.weights) > 2 * self.most:
            self.lower()

    def lower(self) -> None:
        """Lowers all counters by the first one too many, which leaves `most` at most."""
        if len(self.weights) > self.most:
            values = np.fromiter(self.weights.values(), np.int64, len(self.weights))
            cut = int(-np.partition(-values, self.most)[self.most])
            self.weights = {k: w - cut for k, w in self.weights.items() if w > cut}
            self.error += cut

    def rows(self) -> pd.DataFrame:
        self.lower()
        return pd.DataFrame({"key": [*self.weights, None], "weight": [*self.weights.values(), 0], "error": [*[0] * len(self.weights), self.error]})


def sketch(items: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """A sketch, as SKETCH, of the keys by their summed weights (whole numbers, none below 0); rows without key are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Counters(most)
        for pdf in batches:
            sums = pdf.groupby("key", sort=False)["weight"].sum()
            own.add(sums.index.tolist(), sums.to_numpy(np.int64))
        yield own.rows()

    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("weight"))
    return merged(rows.mapInPandas(run, SKETCH), most)


def merged(sketches: DataFrame, most: int) -> DataFrame:
    """The union of sketches as one: counters are summed, and lowered by the first one too many."""
    sums = stored(sketches.groupBy("key").agg(F.sum("weight").alias("weight"), F.sum("error").alias("error")), "sketches")
    first = sums.where("key IS NOT NULL").select("weight").orderBy(F.desc("weight")).limit(most + 1)
    cut = first.agg(F.when(F.count("*") > most, F.min("weight")).otherwise(0).alias("cut"))  # one row, of most + 1
    left = sums.join(F.broadcast(cut), F.lit(True))
    return left.select("key", F.when(F.col("key").isNull(), 0).otherwise(F.col("weight") - F.col("cut")).alias("weight"), F.when(F.col("key").isNull(), F.col("error") + F.col("cut")).otherwise(0).alias("error")).where("key IS NULL OR weight > 0")


def error_of(whole: DataFrame) -> int:
    return whole.agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]


def top_duplicates(items: DataFrame, n: int = 10, most: int = 1024, first: DataFrame | None = None) -> DataFrame:
    """ledger.top_duplicates over items (seq, model, key, est_tokens, text), without a table of all keys: the exact counts of the
    keys of a sketch. `first` is a sketch that is there already, of `most` counters."""
    while True:
        whole = stored(sketch(items, "key", "est_tokens", most) if first is None else first, "heavy-keys")
        keys = whole.where("key IS NOT NULL").select("key")
        found = stored(ledger.top_duplicates(items.join(if_small(keys, most, 96), "key", "left_semi"), n), "heavy-found")
        error = error_of(whole)
        count, least = found.agg(F.count("*"), F.min("wasted_tokens")).first()
        # A key without counter weighs the error at most, of which the first occurrence is no waste.
        if not error or count == n and least >= error:
            return found
        most, first = 4 * most, None
