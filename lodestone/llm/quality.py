"""Quality rules: a table of thresholds, compiled into one projection of Spark expressions.

A rule names a measure of the text (its length, or a share of its words, lines or characters), the least and most that it may be,
and the number of words from which it applies. Measures are column expressions over one text; the compiled projection holds
each measure once, beside a flag for each rule, and no user function: no row leaves the JVM and none is shuffled.

Words found in repeated windows are counted by sorting. A window is a 64-bit hash whose low bits give way to the window's place, so
a text's windows are one array of numbers, whose sorted order brings equal windows together and keeps their places. Neighbours
with equal hashes are compared word by word; where a neighbour turns out to be another window, the text's windows are sorted
again as texts, so the count is exact, at n log n steps whatever the text.

Scale: one pass over the scan; a task holds one text and a few arrays of its words.

Defined results: null, empty and white texts have no words and fail; doc_id is passed through, also null and repeated ones, a row for each
row; an empty table gives no rows; other columns pass untouched through `verdicts` and the filter, also those named like its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let
from lodestone.llm.common import SPACES, fresh

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS, REPEATED_PERCENT = 50, 50  # of the base rules

# Frequent function words of the four languages of the corpora.
STOP_WORDS = {
    "en": "the be to of and that have with this is it was for on are as at by an in not or from",
    "de": "der die das und ist nicht ein eine mit von zu den auf für im des sich dem als auch es an",
    "fr": "le la les de des et est un une que qui dans pour pas sur au du en ne se ce",
    "es": "el la los las de y que en un una es por con para no se su al lo del como",
}

@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The query's thresholds.
RULES = (
    Rule("words", "n_words", least=LEAST_WORDS),
    Rule("repeated", "repeated_percent", most=REPEATED_PERCENT),
    Rule("word_length", "word_length", least=2.5, most=12),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("capitals", "capital_ratio", most=0.4),
    Rule("duplicate_lines", "duplicate_lines", most=0.4),
    Rule("bullet_lines", "bullet_lines", most=0.9),
    Rule("ellipsis_lines", "ellipsis_lines", most=0.3),
)


# --- measures -----------------------------------------------------------------------------------------------


def words_of(text: Column) -> Column:
    """The words of a text as an array, empty for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACES}]+"))


def lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACES}]"))


def _window(words: Column, at: Column) -> list[Column]:
    return [F.get(words, (at + k).cast("int")) for k in range(WINDOW)]


def _windows(words: Column, one) -> Column:
    """one(its words, its place) for each window of WINDOW words; none for texts of fewer."""
    whole = F.transform(words, lambda w, i: one([w, *[F.get(words, i + k) for k in range(1, WINDOW)]], i))
    return F.slice(whole, F.lit(1), F.greatest(F.size(words) - WINDOW + 1, F.lit(0)))


def _covered(starts: Column) -> Column:
    """Words in the windows that start at these places, in rising order."""
    gap = lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)))
    return F.aggregate(F.transform(starts, gap), F.lit(0).cast("long"), lambda a, x: a + x)


def _places(marked: Column) -> Column:
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def _by_text(words: Column) -> Column:
    """Places of windows found twice or more, by sorting the windows' texts. No word holds a space, so joined words tell
    windows apart."""
    one = lambda own, i: F.struct(F.concat_ws(" ", *own).alias("w"), i.cast("long").alias("i"))
    twice = lambda s: F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]), x["i"]))
    return _places(let(F.sort_array(_windows(words, one)), twice))


def _by_hash(words: Column, hashed) -> Column:
    """The same places, by sorting hashes; null where two windows side by side share a hash but not their words."""

    def found(keys: Column, mask: Column) -> Column:
        alike = lambda a, b: F.coalesce(a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(mask)) == 0, F.lit(False))

        def same(a: Column, b: Column) -> Column:
            first, *rest = [x == y for x, y in zip(_window(words, a.bitwiseAND(mask)), _window(words, b.bitwiseAND(mask)), strict=True)]
            for r in rest:
                first = first & r
            return first

        # A key's mark: 0 unlike the one before it, 1 equal to it, 2 alike but another window.
        mark = lambda x, k: F.when(~alike(x, F.get(keys, k - 1)), 0).when(same(x, F.get(keys, k - 1)), 1).otherwise(2)
        twice = lambda marks: F.transform(keys, lambda x, k: F.when((F.get(marks, k) == 1) | (F.get(marks, k + 1) == 1), x.bitwiseAND(mask)))
        return let(F.transform(keys, mark), lambda marks: F.when(~F.array_contains(marks, 2), _places(twice(marks))))

    # So many low bits of a hash give way to the place.
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(words)))) - 1
    key = lambda m: lambda own, i: hashed(*own).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long"))
    return let(mask, lambda m: let(F.sort_array(_windows(words, key(m))), lambda keys: found(keys, m)))


def repeated_words(words: Column, hashed=F.xxhash64) -> Column:
    """Words that lie in a window found twice or more among the words, the first included. Where all hashes differ, as in most
    texts, so do all windows."""
    differ = let(_windows(words, lambda own, i: hashed(*own)), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    sorted_ = let(_by_hash(words, hashed), lambda found: _covered(F.coalesce(found, _by_text(words))))
    return F.when(differ, F.lit(0).cast("long")).otherwise(sorted_)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _stop_words(words: Column) -> Column:
    """Share of words that are frequent in one of the languages, with a small or a large first letter; the highest over the languages."""
    both = {lang: [form for w in named.split() for form in (w, w.capitalize())] for lang, named in STOP_WORDS.items()}
    frequent = F.filter(words, lambda w: w.isin(sorted({w for own in both.values() for w in own})))
    count = lambda found, own: F.size(F.filter(found, lambda w: w.isin(own)))
    return let(frequent, lambda found: _share(F.greatest(*[count(found, own) for own in both.values()]), F.size(words)))


def _matching(lines: Column, pattern: str) -> Column:
    return _share(F.size(F.filter(lines, lambda x: x.rlike(pattern))), F.size(lines))


#: What is measured on a text, on its words and on its lines.
OF_TEXT = {
    "word_chars": lambda text: F.length(F.translate(F.coalesce(text, F.lit("")), SPACE, "")).cast("long"),
    "n_symbols": lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{SYMBOLS}]")).cast("long"),
    "n_capitals": lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\p{Lu}")).cast("long"),
}
OF_WORDS = {
    "n_words": lambda words: F.size(words).cast("long"),
    "n_repeat_words": repeated_words,
    "stop_ratio": _stop_words,
}
OF_LINES = {
    "n_lines": lambda lines: F.size(lines).cast("long"),
    "n_dup_lines": lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    "bullet_lines": lambda lines: _matching(lines, rf"^[{SPACES}]*[-*\x{{2022}}]"),
    "ellipsis_lines": lambda lines: _matching(lines, rf"(\.\.\.|\x{{2026}})[{SPACES}]*$"),
}

#: Ratios of measures, and what they are computed from.
RATIOS = {
    "repeated_percent": (("n_repeat_words", "n_words"), lambda a, b: _share(100 * a, b)),
    "word_length": (("word_chars", "n_words"), _share),
    "symbol_ratio": (("n_symbols", "n_words"), _share),
    "capital_ratio": (("n_capitals", "word_chars"), _share),
    "duplicate_lines": (("n_dup_lines", "n_lines"), _share),
}


# --- compilation --------------------------------------------------------------------------------------------


def measures_for(rules: tuple[Rule, ...], more: tuple[str, ...] = ()) -> list[str]:
    """The measures that rules are computed from, each once."""
    named = [*more, "n_words"]
    for r in rules:
        named += RATIOS[r.measure][0] if r.measure in RATIOS else (r.measure,)
    if unknown := set(named) - {*OF_TEXT, *OF_WORDS, *OF_LINES}:
        raise ValueError(f"unknown measures: {', '.join(sorted(unknown))}")
    return list(dict.fromkeys(named))


def measured(text: Column, named: list[str]) -> Column:
    """A struct of measures. A text is cut into words and lines once."""
    pick = lambda own, of: F.struct(*[own[n](of).alias(n) for n in named if n in own])
    parts = {}
    if any(n in OF_LINES for n in named):
        parts["lines"] = let(lines_of(text), lambda lines: pick(OF_LINES, lines))
    if any(n in OF_TEXT for n in named):
        parts["text"] = pick(OF_TEXT, text)
    parts["words"] = let(words_of(text), lambda words: pick(OF_WORDS, words))
    groups = {"lines": OF_LINES, "text": OF_TEXT, "words": OF_WORDS}
    return let(F.struct(*[c.alias(k) for k, c in parts.items()]), lambda whole: F.struct(*[whole[next(k for k in groups if n in groups[k])][n].alias(n) for n in named]))


def passes(rule: Rule, m: dict[str, Column]) -> Column:
    """Whether a text passes a rule; a text with fewer words than the rule applies from does."""
    needs, ratio = RATIOS.get(rule.measure, ((rule.measure,), lambda x: x))
    value = ratio(*[m[n] for n in needs])
    fine = F.lit(True)
    if rule.least is not None:
        fine = fine & (value >= rule.least)
    if rule.most is not None:
        fine = fine & (value <= rule.most)
    return fine if not rule.from_words else (m["n_words"] < rule.from_words) | fine


def verdicts(docs: DataFrame, text: Column, rules: tuple[Rule, ...] = RULES, more: tuple[str, ...] = ()) -> tuple[DataFrame, str, str]:
    """docs with two columns, whose names are given back: a struct of the measures, and the names of the rules that the text
    fails, in the table's order."""
    own, failed = fresh(docs, "measures", "failed")
    named = measures_for(rules, more)
    rows = docs.withColumn(own, measured(text, named))
    m = {n: F.col(f"{own}.{n}") for n in named}
    names = F.array(*[F.when(~passes(r, m), F.lit(r.name)) for r in rules])
    return rows.withColumn(failed, F.filter(names, lambda x: x.isNotNull())), own, failed


def without_poor(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass all rules, with the columns of docs."""
    rows, _, failed = verdicts(docs, F.col("text"), rules)
    return rows.where(F.size(failed) == 0).select(*docs.columns)


def op12_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed for every document."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows, m, failed = verdicts(docs.select("doc_id", "text"), F.col("text"), rules, counts)
    words, repeated = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    base = (words < LEAST_WORDS) | (100 * repeated > REPEATED_PERCENT * words)
    return rows.select("doc_id", *[F.col(f"{m}.{c}").alias(c) for c in counts], base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed"))


# --- SQL ----------------------------------------------------------------------------------------------------


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    share = lambda part, whole: f"CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / {whole} ELSE 0.0 END"
    ratios = {
        "repeated_percent": share("100 * n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "n_words"),
        "capital_ratio": share("n_capitals", "word_chars"), "duplicate_lines": share("n_dup_lines", "n_lines"),
    }
    lines = lambda pattern: share(f"len(list_filter(lines, lambda x: regexp_matches(x, '{pattern}')))", "len(lines)")
    forms = lambda named: ", ".join(f"'{form}'" for w in named.split() for form in (w, w.capitalize()))
    stops = ", ".join(f"len(list_filter(words, lambda w: w IN ({forms(named)})))" for named in STOP_WORDS.values())

    def fails(r: Rule) -> str:
        value = ratios.get(r.measure, r.measure)
        outside = [f"({value}) < {r.least}::DOUBLE"] * (r.least is not None) + [f"({value}) > {r.most}::DOUBLE"] * (r.most is not None)
        return f"CASE WHEN n_words >= {r.from_words} AND ({' OR '.join(outside)}) THEN '{r.name}' END"

    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{SPACES}]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACES}]')) AS lines,
         row_number() OVER () AS row_
  FROM documents
), windows AS (
  SELECT row_, unnest(range(1, len(words) - 1)) AS s, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS w
  FROM texts WHERE len(words) >= 3
), twice AS (
  SELECT row_, s, lead(s) OVER (PARTITION BY row_ ORDER BY s) AS next_s
  FROM (SELECT *, count(*) OVER (PARTITION BY row_, w) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT row_, sum(least(3, coalesce(next_s - s, 3))) AS n FROM twice GROUP BY row_
), measured AS (
  SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_capitals, {share(f"greatest({stops})", "len(words)")} AS stop_ratio,
         {lines(rf"^[{SPACES}]*[-*•]")} AS bullet_lines, {lines(rf"(\.\.\.|…)[{SPACES}]*$")} AS ellipsis_lines
  FROM texts LEFT JOIN repeated USING (row_)
), judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed,
         list_filter([{", ".join(map(fails, rules))}], lambda x: x IS NOT NULL) AS failed_
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed_) = 0 AS kept, array_to_string(failed_, ',') AS failed
FROM judged
"""
