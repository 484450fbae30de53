"""Request logs: reading JSON lines, finding the request in its envelope, and exploding inputs into items."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

# Fields of a request that are not provider parameters, and the fields that may wrap a request, in order.
KNOWN = ("input", "model", "encoding_format", "dimensions", "user")
ENVELOPES = ("body", "request", "payload", "kwargs", "request_kwargs", "json_data", "json", "data")


def read_log(spark: SparkSession, paths: str | list[str], most_bytes: int = 64 << 20) -> DataFrame:
    """Lines of one or more logs (value) with a seq that follows the order of the paths, of files by name and of lines; blank
    lines are left out. Lines are numbered by the running number of lines in the parts of files before theirs, whatever order
    the parts are read in, which takes a read of its own (sources.lines numbers by bytes instead). A line of more than
    `most_bytes` is an error."""
    found = None
    for place, path in enumerate([paths] if isinstance(paths, str) else paths):
        lines = spark.read.text(path).select("value", F.lit(place).alias("_place"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_n"))
        found = lines if found is None else found.unionByName(lines)
    part = ["_place", "_file", "_start"]
    parts = found.groupBy(*part).agg(F.min("_n").alias("_first"), F.count("*").alias("_lines"))
    before = W.Window.orderBy(*part).rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each part of a file
    parts = parts.withColumn("_base", F.coalesce(F.sum("_lines").over(before), F.lit(0))).drop("_lines")
    rows = found.join(parts, part).select("value", (F.col("_base") + F.col("_n") - F.col("_first")).alias("seq"))
    long = F.raise_error(F.concat(F.lit("line "), F.col("seq").cast("string"), F.lit(f" is longer than {most_bytes} bytes"))).cast("string")
    rows = rows.withColumn("value", F.when(F.octet_length("value") > most_bytes, long).otherwise(F.col("value")))
    return rows.where(F.regexp_replace("value", r"\s+", "") != "")


def write_log(requests: DataFrame, path: str) -> None:
    """One JSON object a line with sorted keys, without empty optional fields."""
    requests.select(encode_request("model", "input", "dimensions", "encoding_format", "user", "params").alias("value")).write.text(path)


def encode_request(model: str, input_: str, dimensions: str, encoding: str, user: str, params: str) -> Column:
    """A request as JSON text: keys in order, names quoted, raw input and parameters, zero-valued optional fields left out."""
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    quoted = lambda c: text(F.col(c))
    own = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("dimensions").alias("key"), F.when(F.coalesce(F.col(dimensions), F.lit(0)) != 0, F.col(dimensions).cast("string")).alias("value")),
                F.struct(F.lit("encoding_format").alias("key"), F.when(F.coalesce(F.col(encoding), F.lit("")) != "", quoted(encoding)).alias("value")),
                F.struct(F.lit("input").alias("key"), F.col(input_).alias("value")),
                F.struct(F.lit("model").alias("key"), quoted(model).alias("value")),
                F.struct(F.lit("user").alias("key"), F.when(F.coalesce(F.col(user), F.lit("")) != "", quoted(user)).alias("value")),
            ),
            lambda e: e["value"].isNotNull(),
        )
    )
    every = F.array_sort(F.map_entries(F.map_concat(own, F.coalesce(F.col(params), F.expr("map()").cast("map<string,string>")))))
    body = F.array_join(F.transform(every, lambda e: F.concat(text(e["key"]), F.lit(":"), e["value"])), ",")
    return F.concat(F.lit("{"), body, F.lit("}"))


def _members(text: Column) -> Column:
    """The members of a JSON object as variants; null for anything else."""
    return F.from_json(text, "map<string,variant>")


def _kind(m: Column, name: str) -> Column:
    return F.schema_of_variant(m[name])


def _is_request(m: Column) -> Column:
    """A non-empty string model and an input, and no known field of a wrong type; null counts as absent."""
    typed = lambda name, kind: F.coalesce(_kind(m, name), F.lit("VOID")).isin("VOID", kind)
    named = (_kind(m, "model") == "STRING") & (F.variant_get(m["model"], "$", "string") != "")
    return F.coalesce(m.isNotNull() & F.map_contains_key(m, F.lit("input")) & named & typed("dimensions", "BIGINT") & typed("encoding_format", "STRING") & typed("user", "STRING"), F.lit(False))


def enveloped(line: Column) -> Column:
    """The request's JSON text: the line itself, or the first of the wrapping fields that holds one, as an object or as text;
    else null."""
    whole = _members(line)

    def inside(m: Column) -> Column:
        found = [F.when(_is_request(m), line)]
        for name in ENVELOPES:
            inner = F.when(_kind(m, name) == "STRING", F.variant_get(m[name], "$", "string")).otherwise(F.to_json(m[name]))
            once = F.transform(F.array(inner), lambda t: F.struct(t.alias("t"), _members(t).alias("m")))  # parsed once, looked at often
            found.append(F.when(F.map_contains_key(m, F.lit(name)), F.get(F.transform(once, lambda x: F.when(_is_request(x["m"]), x["t"])), F.lit(0))))
        return F.coalesce(*found)

    return F.get(F.transform(F.array(whole), inside), F.lit(0))


def _search(value) -> dict | None:
    if isinstance(value, dict):
        if isinstance(value.get("model"), str) and value["model"] and "input" in value:
            return value
        children = [value[k] for k in sorted(value)]
    elif isinstance(value, list):
        children = value
    elif isinstance(value, str):
        try:
            return _search(json.loads(value)) if value[:1] in "{[\"" else None
        except ValueError:
            return None
    else:
        return None
    return next((r for c in children if (r := _search(c)) is not None), None)


@F.pandas_udf(T.StringType())
def nested(lines: pd.Series) -> pd.Series:
    """A request nested anywhere in a line, also inside strings, depth first in order of keys; else null."""
    return lines.map(_nested)


def _nested(line) -> str | None:
    try:
        found = _search(json.loads(line))
    except (TypeError, ValueError):
        return None
    if found is None or not _holds_request({k: json.dumps(found[k]) for k in KNOWN if k in found}):
        return None
    return json.dumps(found, ensure_ascii=False, sort_keys=True)


def extract(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with `request`, the JSON text of the request that they hold, or null. Only lines whose envelope is not among
    the known ones are handed to Python to be walked."""
    first = lines.withColumn("_first", enveloped(F.col(value)))
    walked = first.withColumn("_nested", nested(F.when(F.col("_first").isNull(), F.col(value))))
    return walked.withColumn("request", F.coalesce("_first", "_nested")).drop("_first", "_nested")


def parse(requests: DataFrame, column: str = "request", ignore: tuple[str, ...] = (), line: str | None = None) -> DataFrame:
    """model, input (JSON text), dimensions, encoding_format, user and params of each request; params maps the names of provider
    parameters to the JSON text of their values, null if there are none. `ignore` names fields of a flat log line that
    are no parameters, such as time stamps. Values are spelt as Spark writes JSON; with `line`, the column of the log line that
    the request was found in, those of requests with parameters are read again, as they were spelt there."""
    rows = requests.withColumn("_m", _members(F.col(column)))
    text = lambda name: F.variant_get(F.col("_m")[name], "$", "string")
    skip = [*KNOWN, *ignore]
    rows = rows.withColumns(
        {
            "model": text("model"),
            "input": F.to_json(F.col("_m")["input"]),
            "dimensions": F.try_variant_get(F.col("_m")["dimensions"], "$", "int"),
            "encoding_format": text("encoding_format"),
            "user": text("user"),
            "params": F.transform_values(F.map_filter("_m", lambda k, v: ~k.isin(skip)), lambda k, v: F.to_json(v)),
        }
    ).drop("_m")
    rows = rows.withColumn("params", F.when(F.size("params") > 0, F.col("params")))
    if line is None:
        return rows
    has = F.col("params").isNotNull()
    spelt = rows.withColumns({"_line": raw_params(F.when(has, F.col(line))), "_own": raw_params(F.when(has, F.col(column)))})
    return spelt.withColumn("params", F.map_filter(F.coalesce("_line", "_own"), lambda k, v: ~k.isin(skip))).drop("_line", "_own")


def _raw_input(request: Column) -> Column:
    return F.to_json(_members(request)["input"])


def items(requests: DataFrame, column: str = "input", outer: bool = False) -> DataFrame:
    """A row for each input item: pos, is_tokens, text, tokens; with `outer`, one of nulls for what has no items. Inputs may be a string, an array of strings, an array of
    integers (one item) or an array of arrays of integers; null counts as an empty text; anything else gives no rows."""
    v = F.try_parse_json(column)
    kind = F.schema_of_variant(v)
    text = lambda c: F.struct(F.lit(False).alias("is_tokens"), c.alias("text"), F.lit(None).cast("array<bigint>").alias("tokens"))
    ids = lambda c: F.struct(F.lit(True).alias("is_tokens"), F.lit(None).cast("string").alias("text"), c.alias("tokens"))
    made = (
        F.when(kind == "STRING", F.array(text(F.variant_get(v, "$", "string"))))
        .when(kind == "VOID", F.array(text(F.lit(""))))
        .when(kind == "ARRAY<STRING>", F.transform(F.variant_get(v, "$", "array<string>"), lambda s: text(F.coalesce(s, F.lit("")))))
        .when(kind == "ARRAY<BIGINT>", F.array(ids(F.variant_get(v, "$", "array<bigint>"))))
        .when(kind == "ARRAY<ARRAY<BIGINT>>", F.transform(F.variant_get(v, "$", "array<array<bigint>>"), ids))
    )
    explode = F.posexplode_outer if outer else F.posexplode
    return requests.select("*", explode(made).alias("pos", "_item")).select(*requests.columns, "pos", "_item.*")


def n_items(input_: Column) -> Column:
    """Number of items of an input (JSON text); null where it has none of the known shapes."""
    v = F.try_parse_json(input_)
    kind = F.schema_of_variant(v)
    counted = F.when(kind.isin("STRING", "ARRAY<BIGINT>", "VOID"), 1).when(kind == "ARRAY<STRING>", F.size(F.variant_get(v, "$", "array<string>")))
    return counted.when(kind == "ARRAY<ARRAY<BIGINT>>", F.size(F.variant_get(v, "$", "array<array<bigint>>")))


def status(requests: DataFrame, most_items: int | None = None, most_bytes: int | None = None, body: str = "value") -> DataFrame:
    """requests (value, request) with n_items and the status that a server would answer before any work: 400 or 413, else 200."""
    rows = requests.withColumn("n_items", n_items(_raw_input(F.col("request"))))
    code = F.lit(200)
    if most_items is not None:
        code = F.when(F.col("n_items") > most_items, 400).otherwise(code)
    code = F.when(F.col("request").isNull() | F.col("n_items").isNull(), 400).otherwise(code)
    if most_bytes is not None:
        code = F.when(F.octet_length(body) > most_bytes, 413).otherwise(code)
    return rows.withColumn("status", code)


def encode_inputs(rows: DataFrame, batch: str, position: str, text: str = "text", tokens: str | None = None) -> DataFrame:
    """The texts of each batch as a JSON array, in order; with `tokens`, the token arrays of batches that have them."""
    ordered = F.array_sort(F.collect_list(F.struct(position, text, *([tokens] if tokens else []))))
    made = F.to_json(F.transform(ordered, lambda s: s[text]))
    if tokens:
        made = F.when(F.exists(ordered, lambda s: s[tokens].isNotNull()), F.to_json(F.transform(ordered, lambda s: F.coalesce(s[tokens], F.array().cast("array<bigint>"))))).otherwise(made)
    return rows.groupBy(batch).agg(made.alias("input"))


def _raw_members(text: str) -> dict[str, str]:
    """Member names and the exact text of their values of a JSON object; nothing for anything else."""
    decoder, found = json.JSONDecoder(), {}
    text = text.strip()
    if not isinstance(json.loads(text), dict):
        return found
    at, space = 1, " \t\r\n"
    while True:
        while text[at] in space + ",":
            at += 1
        if text[at] == "}":
            return found
        name, at = decoder.raw_decode(text, at)
        while text[at] in space + ":":
            at += 1
        start = at
        _, at = decoder.raw_decode(text, at)
        found[name] = text[start:at]


def _holds_request(members: dict[str, str]) -> bool:
    if "input" not in members or "model" not in members:
        return False
    known = {k: json.loads(members[k]) for k in ("model", "dimensions", "encoding_format", "user") if k in members}
    whole = known.get("dimensions")
    texts = all(known.get(k) is None or isinstance(known[k], str) for k in ("encoding_format", "user"))
    return isinstance(known["model"], str) and known["model"] != "" and texts and (whole is None or isinstance(whole, int) and not isinstance(whole, bool))


def _raw_request(line: str) -> dict[str, str] | None:
    """The members of the request that a line is, or that one of the wrapping fields holds."""
    whole = _raw_members(line)
    if _holds_request(whole):
        return whole
    for name in ENVELOPES:
        try:
            value = whole.get(name, "")
            inner = _raw_members(json.loads(value) if value[:1] == '"' else value)
        except ValueError:
            continue
        if _holds_request(inner):
            return inner
    return None


def _raw_params(line) -> dict[str, str] | None:
    try:
        found = _raw_request(line) if isinstance(line, str) else None
    except ValueError:
        return None
    return None if found is None else {k: v for k, v in found.items() if k not in KNOWN}


def _raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lines in batches:
        yield lines.map(_raw_params)


raw_params = F.pandas_udf(_raw, T.MapType(T.StringType(), T.StringType()))
"""Provider parameters of the request in a line with the exact text of their values, so that 1.50 and 1.5 differ."""


#: Lines that are held in Python as objects at once.
AT_ONCE = 512

_READ = pa.struct([("request", pa.string()), ("params", pa.map_(pa.string(), pa.string()))])


def _read_again(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What is left to Python of lines and the requests that Spark found in them: requests nested elsewhere, and parameters as spelt."""

    def one(line: str | None, first: str | None) -> dict | None:
        request = None if line is None or first is not None else _nested(line)
        own = first if request is None else request
        if line is None or own is None:
            return None
        params = _raw_params(line)
        params = _raw_params(own) if params is None else params
        return {"request": request, "params": None if params is None else list(params.items())}

    for lines, firsts in batches:
        for k in range(0, max(1, len(lines)), AT_ONCE):
            pairs = zip(lines.slice(k, AT_ONCE).to_pylist(), firsts.slice(k, AT_ONCE).to_pylist(), strict=True)
            yield pa.array([one(*p) for p in pairs], _READ)


_read = F.arrow_udf(_read_again, T.StructType().add("request", "string").add("params", T.MapType(T.StringType(), T.StringType()))).asNondeterministic()


def read(lines: DataFrame, ignore: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """parse(extract(lines), ignore=ignore, line=value) with one call of Python, which filters on the result do not repeat."""
    skip = [*KNOWN, *ignore]
    first = lines.withColumn("_first", enveloped(F.col(value)))
    more = F.coalesce(F.size(F.array_except(F.json_object_keys("_first"), F.array(*[F.lit(k) for k in skip]))) > 0, F.lit(True))
    again = first.withColumn("_py", _read(F.when(more, F.col(value)), F.col("_first")))
    rows = parse(again.withColumn("request", F.coalesce("_first", "_py.request")).drop("_first"), ignore=ignore)
    spelt = F.map_filter(F.col("_py.params"), lambda k, v: ~k.isin(skip))
    return rows.withColumn("params", F.when(F.col("params").isNotNull(), spelt)).drop("_py")
