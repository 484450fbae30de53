"""Text functions: normalisation, token estimates, previews, character trigrams."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space when a text is trimmed or collapsed, and the scripts whose characters are a
# token each, both as the insides of a character class.
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WIDE = r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}\x{3000}-\x{303F}"

# The letters that each combining mark composes with; any other pair stays as it is.
MARKED = {
    "̀": "aeiouAEIOU",
    "́": "aeiouyAEIOUY",
    "̂": "aeiouAEIOU",
    "̃": "anoANO",
    "̈": "aeiouyAEIOU",
    "̊": "aA",
    "̧": "cC",
}
COMPOSED = {letter + mark: unicodedata.normalize("NFC", letter + mark) for mark, letters in MARKED.items() for letter in letters}

RULES = ("nfc", "trim", "collapse", "lowercase")


def fold(text: Column) -> Column:
    """Composes letter and mark where COMPOSED has the pair. No composed letter starts another pair, so order is free."""
    out = text
    for pair, letter in COMPOSED.items():
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return F.when(text.rlike(r"[\x{300}-\x{36F}]"), out).otherwise(text)


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+$", "")


#: The same white space as characters.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none at the ends. Only runs of spaces meet a regular expression."""
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def parse_rules(spec: str) -> tuple[str, ...]:
    """The rules named in a comma-separated list, in the order in which they apply; blanks are skipped."""
    named = {r.strip() for r in spec.split(",") if r.strip()}
    if unknown := named - set(RULES):
        raise ValueError(f"unknown normalisation rules: {', '.join(sorted(unknown))}")
    return tuple(r for r in RULES if r in named)


def normalize(text: Column, rules: str | tuple[str, ...] = ()) -> Column:
    """Text in the form that identity is taken from; unchanged without rules."""
    apply = {"nfc": fold, "trim": trim, "collapse": collapse, "lowercase": F.lower}
    named = parse_rules(rules) if isinstance(rules, str) else rules
    for r in named:
        if r != "trim" or "collapse" not in named:  # collapsing trims, too
            text = apply[r](text)
    return text


def estimate_tokens(text: Column) -> Column:
    """Wide characters count one token each, all others a token for four bytes, rounded up; at least 1."""
    size = F.octet_length(text)
    narrow = F.regexp_replace(text, f"[{WIDE}]", "")
    wide = F.length(text) - F.length(narrow)
    mixed = wide + F.floor((F.octet_length(narrow) + 3) / 4)
    plain = F.floor((size + 3) / 4)
    return F.greatest(F.lit(1), F.when(size == F.length(text), plain).otherwise(mixed)).cast("long")


def estimate_token_items(tokens: Column) -> Column:
    """Tokens of an input that is an array of token ids; at least 1."""
    return F.greatest(F.lit(1), F.size(tokens)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it in a lambda (which would evaluate it for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def preview(text: Column, most: int = 60) -> Column:
    """Collapsed text; beyond `most` bytes, whole characters of the first most - 3 bytes and three dots."""
    return let(collapse(text), lambda flat: F.when(F.octet_length(flat) > most, F.concat(_cut(flat, most - 3), F.lit("..."))).otherwise(flat))


def _cut(text: Column, size: int) -> Column:
    """The longest prefix of at most `size` bytes."""
    head = F.substring(text, 1, size)
    lengths = F.filter(F.sequence(F.lit(0), F.length(head)), lambda n: F.octet_length(F.substring(head, F.lit(1), n)) <= size)
    return F.when(F.octet_length(head) <= size, head).otherwise(F.substring(head, F.lit(1), F.array_max(lengths)))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the lower-cased, collapsed text with a space at each end; a shorter form is its own. The
    text is cut into characters once, since finding the n-th character of a text takes n steps."""

    def grams(chars: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
        return F.when(F.size(chars) < 3, F.array(F.array_join(chars, ""))).otherwise(F.array_distinct(own))

    padded = F.concat(F.lit(" "), collapse(F.lower(text)), F.lit(" "))
    return let(F.regexp_extract_all(padded, F.lit("(?s)."), F.lit(0)), grams)


def trigram_codes(text: Column) -> Column:
    """The same trigrams as integers: the code points of three characters side by side, so that sets compare fast."""

    def code(g: Column) -> Column:
        at = lambda k: F.ascii(F.substring(g, k, 1)).cast("long")
        return F.shiftleft(at(1), 42) + F.shiftleft(at(2), 21) + at(3)

    return F.transform(trigrams(text), code)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def numbered_lines(text: Column, most: int) -> Column:
    """Up to `most` items of a numbered list, filled up with the text's lines where there are fewer."""
    items = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d+[.)]\s*(.+)$"), F.lit(1)), trim)
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda s: s != "")
    first = F.slice(items, 1, most)
    return F.when(F.size(first) >= most, first).otherwise(F.slice(F.concat(first, lines), 1, most))
