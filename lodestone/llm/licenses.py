"""Licence scan by ordered signature rules, in DataFrame expressions only.

Texts are normalised to words; a short list of anchors, one of which every rule's keyword holds, passes few texts on, and
on those each rule whose keyword occurs is matched as a regular expression. Detections are word intervals. Where one
lies inside another of its own or a higher-ranking tier, it is suppressed. Four base phrases are located apart from the
rules, at all places, and their labels always stay.

Scale: one pass over the documents, row by row, no shuffle; the rules are a constant of the plan. Suppression sweeps a
document's detections in order of their start, in blocks, so its work grows with their number and not with pairs, except for a pass over the sums of the blocks before each.

Defined results: null text is empty: no words, no labels, null positions, score 0; repeated rows and null ids give a row
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower
from lodestone.llm.license_rules import CONFIDENCE, rules
from lodestone.sources.tables import spread

#: What separates words, in either case: all of ASCII but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Items that are folded together.
CHUNK = 128

#: Phrases that are always reported, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Every keyword of a rule and every base phrase holds one of these.
ANCHORS = ("licen", "copyright", "public domain", "creative commons", "cc by", "cc0", "gpl", "bsd", "wtfpl", "permission", "redistribution", "warrant", "rights reserved", "advertising materials", "altered source", "promote products", "mit no attribution", "apache 2 0", "mpl 2 0", "epl 1 0", "epl 2 0")


def _rule_literal() -> Column:
    found = rules()
    loose = [r for r in found if not any(a in r[2] for a in ANCHORS)]
    if loose:
        raise ValueError(f"no anchor passes {loose}")
    text = json.dumps([{"n": n, "label": label, "tier": tier, "keyword": keyword, "rx": f"(?<= )(?:{rx})(?= )"} for n, (label, tier, keyword, rx) in enumerate(found)])
    return F.from_json(F.lit(text), "array<struct<n: int, label: string, tier: int, keyword: string, rx: string>>")


def _spaces(c: str) -> str:
    return f"(octet_length({c}) - octet_length(replace({c}, ' ', '')))"


def _let(value: str, name: str, body: str) -> str:
    """The expression body with a name for a value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _blocks(items: str) -> str:
    return f"transform(sequence(0, (size({items}) - 1) div {CHUNK}), b -> slice({items}, b * {CHUNK} + 1, {CHUNK}))"


# Spark copies an accumulator at each step of a fold, so what grows with a document is folded in blocks of CHUNK items, each
# beginning from what the blocks before it sum up to.

_PIECES = f"""zip_with(split(_norm, r.rx, -1), regexp_extract_all(_norm, r.rx, 0),
  (p, m) -> struct(cast({_spaces('p')} as bigint) AS before, cast({_spaces("coalesce(m, '')")} as bigint) AS inside, m IS NOT NULL AS hit))"""

_STARTS = """aggregate(q, struct(base AS at, cast(array() as array<bigint>) AS out),
  (acc, x) -> struct(acc.at + x.before + x.inside AS at, concat(acc.out, array(acc.at + x.before - 1)) AS out)).out"""

_IN_BLOCK = _let("aggregate(slice(sums, 1, b), 0L, (n, x) -> n + x)", "base", f"zip_with(q, {_STARTS}, (x, s) -> struct(s AS start, s + 1 + x.inside AS stop, x.hit AS hit))")

_SPANS = _let(_PIECES, "ps", _let(_blocks("ps"), "bs", _let("transform(bs, q -> aggregate(q, 0L, (n, x) -> n + x.before + x.inside))", "sums", f"filter(flatten(transform(bs, (q, b) -> {_IN_BLOCK})), x -> x.hit)")))

_DETECTIONS = f"""
array_sort(flatten(transform(filter(_rules, r -> contains(_norm, r.keyword)),
  r -> transform({_SPANS}, s -> struct(s.start AS start, -s.stop AS minus_stop, r.tier AS tier, r.n AS n, r.label AS label)))))
"""

_COVERED = "array_max(slice(acc.reach, 1, d.tier + 1)) >= -d.minus_stop"

_TIERS = f"sequence(0, {len(CONFIDENCE) - 1})"

# How far detections of each tier have reached before a block. One that is suppressed reaches no further than what suppresses it.
_REACH = f"transform({_TIERS}, t -> coalesce(array_max(transform(slice(tops, 1, b), x -> x[t])), -1L))"

_STAND = f"""aggregate(q, struct(reach AS reach, cast(array() as array<boolean>) AS out),
  (acc, d) -> struct(transform(acc.reach, (v, k) -> if(k = d.tier, greatest(v, -d.minus_stop), v)) AS reach, concat(acc.out, array(NOT ({_COVERED}))) AS out)).out"""

_KEPT_BLOCK = _let(_REACH, "reach", f"zip_with(q, {_STAND}, (d, k) -> if(k, struct(d.start AS start, -d.minus_stop AS stop, d.tier AS tier, d.label AS label), NULL))")

_TOPS = f"transform(bs, q -> transform({_TIERS}, t -> array_max(transform(filter(q, d -> d.tier = t), d -> -d.minus_stop))))"

_KEPT = _let(_blocks("_detections"), "bs", _let(_TOPS, "tops", f"filter(flatten(transform(bs, (q, b) -> {_KEPT_BLOCK})), x -> x IS NOT NULL)"))


def _places(phrase: str) -> Column:
    """All positions at which the phrase's words stand in `_words`."""
    own = phrase.split(" ")
    same = " AND ".join(f"_words[i + {k}] = '{w}'" for k, w in enumerate(own))
    return F.expr(f"CASE WHEN size(_words) >= {len(own)} THEN filter(sequence(0L, size(_words) - {len(own)}L), i -> {same}) ELSE cast(array() as array<bigint>) END")


def scan(docs: DataFrame, text: Column) -> DataFrame:
    """docs with _n_words, _base (label and positions of each base phrase), and _kept: the detections that stand, with start
    and stop in words, tier and label. `_base` and `_kept` are null where no anchor occurs."""
    inner = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BETWEEN, " "))
    rows = docs.withColumn("_inner", inner)
    gate = F.lit(False)
    for a in ANCHORS:
        gate = gate | F.contains("_low", F.lit(a))
    rows = rows.withColumn("_low", F.lower("_inner"))
    rows = rows.withColumns({"_n_words": F.when(F.col("_inner") == "", 0).otherwise(F.expr(_spaces("_inner")) + 1).cast("long"), "_norm": F.when(gate, F.concat(F.lit(" "), ascii_lower(F.col("_inner")), F.lit(" ")))})
    rows = rows.drop("_inner", "_low").withColumns({"_words": F.split(F.trim("_norm"), " "), "_rules": F.when(F.col("_norm").isNotNull(), _rule_literal())})
    base = F.array(*[F.struct(F.lit(label).alias("label"), _places(phrase).alias("places")) for phrase, label in BASE])
    rows = rows.withColumns({"_detections": F.expr(_DETECTIONS), "_base": F.when(F.col("_norm").isNotNull(), base)})
    return rows.withColumn("_kept", F.expr(_KEPT)).drop("_norm", "_words", "_rules", "_detections")


def op4_licenses(docs: DataFrame) -> DataFrame:
    rows = scan(spread(docs.select("doc_id", F.col("text").alias("_text"))), F.col("_text"))
    places = F.coalesce(F.expr("flatten(transform(_base, b -> b.places))"), F.array().cast("array<bigint>"))
    base_labels = F.coalesce(F.expr("transform(filter(_base, b -> size(b.places) > 0), b -> b.label)"), F.array().cast("array<string>"))
    own_labels = F.coalesce(F.expr("transform(_kept, d -> d.label)"), F.array().cast("array<string>"))
    tier = F.expr("array_min(transform(_kept, d -> d.tier))")
    rows = rows.select("doc_id", "_n_words", places.alias("_places"), base_labels.alias("_base_labels"), own_labels.alias("_own"), tier.alias("_tier"))
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    score = F.coalesce(*[F.when(F.col("_tier") == t, c) for t, c in enumerate(CONFIDENCE)], F.when(F.size("_base_labels") > 0, CONFIDENCE[1]), F.lit(0.0))
    return rows.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").alias("first_word"),
        F.array_max("_places").alias("last_word"),
        joined(F.col("_base_labels")).alias("base_labels"),
        joined(F.concat("_base_labels", "_own")).alias("labels"),
        score.cast("double").alias("score"),
    )
