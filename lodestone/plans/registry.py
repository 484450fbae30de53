"""The registry of queries and the SQL fragments that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DAY = 86_400
LIMIT, OWN_LIMIT = 400, 150


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- SQL fragments ------------------------------------------------------------------------------------------


def _filled(template: str, **parts: str | int) -> str:
    for name, value in parts.items():
        template = template.replace("{" + name + "}", str(value))
    return template


_KEY = "sha256(encode('ec2') || '\\x00'::BLOB || encode({model}) || '\\x00'::BLOB || encode('0') || '\\x00\\x00\\x00'::BLOB || encode('s') || '\\x00'::BLOB || encode({text}))"
_NARROW = f"regexp_replace({{text}}, '[{text.WIDE}]', '', 'g')"
_TOKENS = f"greatest(1, length({{text}}) - length({_NARROW}) + (strlen({_NARROW}) + 3) // 4)"
_COLLAPSE = f"trim(regexp_replace({{text}}, '[{text.WHITE}]+', ' ', 'g'))"
_USD = "{tokens} * CASE {model} WHEN 'text-embedding-3-small' THEN 0.02::DOUBLE WHEN 'text-embedding-3-large' THEN 0.13::DOUBLE WHEN 'text-embedding-ada-002' THEN 0.10::DOUBLE ELSE 0.02::DOUBLE END / 1e6::DOUBLE"


def _sql_items(model: str, text_: str, table: str, more: str) -> str:
    return f"items AS (SELECT {more}, {model} AS model, {text_} AS text, {_filled(_KEY, model=model, text=text_)} AS key, CAST({_filled(_TOKENS, text=text_)} AS BIGINT) AS tok FROM {table})"


_DOCS = _sql_items("'embed-' || lang", "text", "documents", "doc_id AS seq")
_EVENTS = _sql_items("event_type", "props", "events", "event_id AS seq, ts, CAST(user_id AS VARCHAR) AS caller, value")
_CONV = _sql_items("role", "text", "conversations", "conv_id, turn, conv_id * 1000 + turn AS seq")
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM items)"
