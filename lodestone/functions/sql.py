"""The engine's functions for SQL texts: estimate_tokens, fingerprint, char_trigrams, cosine_similarity, cdc_chunks."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestone.functions.text import WHITE, WIDE

_NARROW = f"regexp_replace(t, r'[{WIDE}]', '')"

#: Name: parameters, type and body. All but cdc_chunks are expressions, which the optimizer sees through; that of char_trigrams
#: gives the padded text to an Arrow function, as arrays of characters cost Spark's expressions 2 microseconds a character.
EXPRESSIONS = {
    "estimate_tokens": ("t STRING", "BIGINT", f"greatest(1, CASE WHEN octet_length(t) = length(t) THEN (octet_length(t) + 3) div 4 ELSE length(t) - length({_NARROW}) + (octet_length({_NARROW}) + 3) div 4 END)"),
    "fingerprint": ("model STRING, t STRING", "STRING", "sha2(concat(X'65633200', encode(model, 'utf-8'), X'0030000000', X'7300', encode(t, 'utf-8')), 256)"),
    "char_trigrams": (
        "t STRING",
        "ARRAY<STRING>",
        f"padded_trigrams(concat(' ', trim(regexp_replace(lower(t), r'[{WHITE}]+', ' ')), ' '))",
    ),
    "cosine_similarity": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "CASE WHEN a IS NULL OR b IS NULL OR size(a) <> size(b) OR size(a) < 1 THEN 0D WHEN aggregate(a, 0D, (n, x) -> n + x * x) * aggregate(b, 0D, (n, x) -> n + x * x) = 0 THEN 0D "
        "ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (n, x) -> n + x) / (sqrt(aggregate(a, 0D, (n, x) -> n + x * x)) * sqrt(aggregate(b, 0D, (n, x) -> n + x * x))) END",
    ),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    from pyspark.sql import functions as F

    from lodestone.functions.grams import padded_trigrams
    from lodestone.operators.chunking import PLACES, place_batches

    spark.udf.register("padded_trigrams", F.arrow_udf(padded_trigrams, "array<string>"))
    for name, (parameters, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("cdc_chunks", F.arrow_udf(place_batches(), PLACES))
