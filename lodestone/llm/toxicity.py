"""Toxicity by gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a text: densities of a written lexicon by kind of abuse, densities of a lexicon learnt from labelled texts
(words and word beginnings, so that inflected forms count), hits near second-person words, rates of capitals, of
punctuation and of obfuscated words, hits after obfuscation is undone, and length. Language, source and ids are no
features.

Training uses at most SAMPLE labelled documents, chosen by hash; the rest of the work is one pass over the documents. The
learnt lexicon is counted in Spark, and only its strongest LEXICON units reach the driver. A document's lexicon features in
training come from the other folds' lexicon, and calibration from out-of-fold scores, so neither sees its own labels.

Defined results: null text is empty; an empty text is scored like any other; without labelled documents every score is
0, with one class only every score is that class; ids with several labels count as toxic if any is, and train with
the first by text of their documents; null ids are not
held out; an empty table gives no rows; the filter keeps all columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.boosting import BoostedTrees, Isotonic
from lodestone.llm.common import give_back_memory, numbered, small_batches, stored, without_rows
from lodestone.sources.tables import spread

SAMPLE = 12_000  # most labelled documents that a model is fitted on
LEXICON = 400  # most units of a learnt lexicon
FOLDS = 4
LEAST_DOCS = 3  # toxic documents that a learnt unit must occur in
PREFIXES = (3, 4, 5, 6)

#: Written lexicon by kind.
WRITTEN = {
    "insult": "idiot idiots moron morons imbecile fool foolish dumb dumbass stupid clown loser losers jerk creep retard twit dimwit halfwit idiote crétin imbécile abruti dummkopf trottel blödmann depp idiota imbécil estúpido tonto",
    "contempt": "pathetic worthless useless disgusting trash garbage scum filth vermin vile repulsive disgrace ridiculous hopeless contemptible ordure minable pitoyable abschaum widerlich wertlos basura asqueroso patético escoria",
    "profanity": "damn hell crap bullshit shit shitty fuck fucking fucker ass asshole bastard bitch bloody merde putain connard salope scheiße arschloch mist mierda puta cabrón joder",
    "threat": "kill die hurt beat destroy punish hang shoot burn strangle tuer mourir crever töten sterben matar morir",
    "hatred": "hate hates hated despise loathe detest haïr déteste hasse verachte odio odiar desprecio",
}
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine euch ihr tú ti usted ustedes vosotros".split())
NEAR = 3

_WORD = re.compile(r"[^\W_]+")
_MASKED = re.compile(r"(?=[^\s]*[^\W\d_])[\w@$*!.\-]*[^\W_][@$*!0-9.\-]+[^\W_][\w@$*!]*")
_MAY_BE_MASKED = re.compile(r"[@$*!0-9.\-](?=[^\W_])")  # every match of _MASKED holds one of this
_UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None})
_KINDS = {w: k for k, own in enumerate(WRITTEN.values()) for w in own.split()}
_RUNS = re.compile(r"([!?])\1+")

N_FEATURES = 2 * len(WRITTEN) + 19


def units(words) -> set[str]:
    """What a learnt lexicon counts: whole words, marked by a final $, and their beginnings."""
    return {w + "$" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = _WORD.findall(text.lower())
    n, chars = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    kinds = [0] * len(WRITTEN)
    weights: dict[str, float] = {}
    weight = lexicon.get
    for w, c in counts.items():
        if w in _KINDS:
            kinds[_KINDS[w]] += c
        best = max(weight(w + "$", 0.0), weight(w[:3], 0.0), weight(w[:4], 0.0), weight(w[:5], 0.0), weight(w[:6], 0.0))
        if best:
            weights[w] = best
    hits = sum(counts[w] for w in weights)
    marked = {*weights, *(w for w in counts if w in _KINDS)}
    near = 0
    if marked and not SECOND_PERSON.isdisjoint(counts):
        spots = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        close = {j for i in spots for j in range(i - NEAR, i + NEAR + 1)}
        near = sum(1 for j in close if 0 <= j < len(words) and words[j] in marked)
    masked = [m.lower() for m in _MASKED.findall(text)] if _MAY_BE_MASKED.search(text) else []
    undone = sum(1 for m in masked if (w := "".join(_WORD.findall(m.translate(_UNMASK)))) in _KINDS or w + "$" in lexicon)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if upper else 0
    top = sorted(weights.values(), reverse=True)
    return [
        *(k / n for k in kinds),
        *(np.log1p(k) for k in kinds),
        hits / n,
        np.log1p(hits),
        float(len(weights)),
        top[0] if top else 0.0,
        top[1] if len(top) > 1 else 0.0,
        sum(c * weights[w] for w, c in counts.items() if w in weights) / n,
        sum(top[:20]),
        near / n,
        float(near),
        upper / chars,
        shouted / n,
        text.count("!") / chars,
        text.count("?") / chars,
        len(_RUNS.findall(text)) / n,
        len(masked) / n,
        float(undone),
        undone / n,
        np.log1p(len(words)),
        len(counts) / n,
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


# --- training -----------------------------------------------------------------------------------------------


_COUNTS = [f"c{k}" for k in range(2 * FOLDS)]


def _counted(parts: Iterator[tuple[list, list, list]]) -> Iterator[list[tuple]]:
    """Of texts, labels and folds: the documents of each fold and label that hold a unit, summed over parts of a partition."""
    found: dict[str, list[int]] = {}

    def out() -> list[tuple]:
        rows = [(u, *c) for u, c in found.items()]
        found.clear()
        return rows

    for texts, labels, folds in parts:
        for text, y, fold in zip(texts, labels, folds, strict=True):
            for u in units(set(_WORD.findall((text or "").lower()))):
                found.setdefault(u, [0] * (2 * FOLDS))[2 * fold + y] += 1
            if len(found) > 200_000:
                yield out()
    yield out()


def _count_units(batches):
    """The counts of pandas frames with text, y and fold."""
    import pandas as pd

    for rows in _counted((pdf["text"], pdf["y"], pdf["fold"]) for pdf in batches):
        yield pd.DataFrame(rows, columns=["unit", *_COUNTS])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of Arrow batches, for which a worker need not load pandas."""
    schema = pa.schema([("unit", pa.string()), *((c, pa.int64()) for c in _COUNTS)])
    for rows in _counted(tuple(b.column(c).to_pylist() for c in ("text", "y", "fold")) for b in batches):
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _strongest(counts: DataFrame, totals: list[int], skipped: int | None) -> dict[str, float]:
    """The units that mark toxic documents most clearly, over all folds but the skipped one, by the lower bound of their log-odds."""
    kept = [k for k in range(FOLDS) if k != skipped]
    toxic, clean = (sum((F.col(f"c{2 * k + y}") for k in kept), F.lit(0)) for y in (1, 0))
    all_toxic, all_clean = (sum(totals[2 * k + y] for k in kept) for y in (1, 0))
    p, q = toxic + 0.5, clean + 0.5
    odds = F.log(p / (all_toxic - toxic + 0.5)) - F.log(q / (all_clean - clean + 0.5))
    bound = odds - 1.64 * F.sqrt(1 / p + 1 / q)
    best = counts.where(toxic >= LEAST_DOCS).select("unit", bound.alias("bound")).where("bound > 1").orderBy(F.desc("bound"), "unit").limit(LEXICON)
    return {r.unit: float(r.bound) for r in best.collect()}


def _feature_rows(lexicons: list[dict[str, float]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or "", lexicons[f]) for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("y"), b.column("fold"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "fold", "x"])

    return rows


class Model:
    """A lexicon, trees over its features and a calibration; a constant where there is nothing to learn from."""

    def __init__(self, constant: float = 0.0) -> None:
        self.constant, self.trees = constant, None
        self.lexicon: dict[str, float] = {}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.lexicon) for t in texts])
        return np.clip(self.calibration(self.trees.margin(x)), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that are not held out."""
    with small_batches(docs.sparkSession):
        return _train(docs, labels, sample)


def _train(docs: DataFrame, labels: DataFrame, sample: int) -> Model:
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    rows = stored(rows, "toxicity-sample")
    totals = [0] * (2 * FOLDS)
    for r in rows.groupBy("fold", "y").count().collect():
        totals[2 * r.fold + r.y] = r["count"]
    toxic, clean = sum(totals[1::2]), sum(totals[::2])
    if not toxic or not clean:
        return Model(1.0 if toxic else 0.0)
    names = _COUNTS
    counts = rows.select("text", "y", "fold").mapInArrow(_count_batches, "unit string, " + ", ".join(f"{c} long" for c in names)).groupBy("unit").agg(*[F.sum(c).alias(c) for c in names])
    counts = stored(counts.where(" + ".join(names[1::2]) + f" >= {LEAST_DOCS}"), "toxicity-units")
    lexicons = [_strongest(counts, totals, k) for k in range(FOLDS)]
    given = T.StructType([*rows.select("doc_id", "y", "fold").schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])
    table = rows.mapInArrow(_feature_rows(lexicons), given).toPandas().sort_values(["doc_id", "y"], kind="stable")
    x, y, fold = np.array(table["x"].tolist()), table["y"].to_numpy(float), table["fold"].to_numpy()
    model = Model()
    model.lexicon = _strongest(counts, totals, None)
    out = np.zeros(len(y))
    for k in range(FOLDS):
        rest = fold != k
        if rest.any() and (~rest).any():
            out[~rest] = BoostedTrees().fit(x[rest], y[rest]).margin(x[~rest])
    model.trees = BoostedTrees().fit(x, y)
    model.calibration = Isotonic().fit(out, y)
    return model


# --- scoring ------------------------------------------------------------------------------------------------


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text, the last column, gives way to its score."""
        for n, batch in enumerate(batches):
            for k in range(0, batch.num_rows, 500):
                *keep, texts = batch.slice(k, 500).columns
                found = model.scores([t or "" for t in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([*keep, pa.array(found, pa.float64())], names=[*batch.schema.names[:-1], "score"])
            if n % 8 == 7:
                give_back_memory()
        give_back_memory()

    return score


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns and the score of each text, stored."""
    rows = spread(docs.select(*keep, F.col("text").alias("score")))
    with small_batches(docs.sparkSession):
        return stored(rows.mapInArrow(_scorer(model), T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])), "toxicity-scores")


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels), "doc_id")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted to be toxic, decided row by row. Only texts go to Python, and the numbers of the rejected
    rows come back."""
    rows, (file, at) = numbered(docs)
    found = scored(rows, train(docs, labels), file, at).where("score >= 0.5")
    return without_rows(rows, [file, at], found.select(file, at)).select(*docs.columns)
