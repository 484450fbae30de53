"""Request logs: envelopes, input shapes, duplicates."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import identity, text
from lodestone.operators import ledger
from lodestone.sources import requests


def analyzed(spark, lines, rules=""):
    log = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "seq long, value string")
    found = requests.extract(log)
    parsed = requests.parse(found.where("request IS NOT NULL"), ignore=("ts", "time"))
    items = requests.items(parsed)
    items = items.withColumn("seq", F.col("seq") * 1000 + F.col("pos"))
    made = ledger.keyed(items.where("NOT is_tokens"), rules)
    s = ledger.duplicate_summary(made).first()
    return found.where("request IS NOT NULL").count(), found.where("request IS NULL").count(), s


def test_envelopes_and_junk(spark):
    one = {"model": "m", "input": "hello world"}
    lines = [json.dumps({"body": one}), json.dumps({"request": json.dumps(one), "ts": 1}), "not json", json.dumps({"model": "chat", "messages": []}), json.dumps({"model": "m", "input": "other"})]
    n, skipped, s = analyzed(spark, lines)
    assert (n, skipped) == (3, 2)
    assert (s["items"], s.unique_items, s.dup_items) == (3, 2, 1)


def test_nested_requests_are_found(spark):
    inner = {"model": "m", "input": ["a b", "c d"]}
    lines = [json.dumps({"log": {"calls": [{"x": 1}, {"deep": json.dumps(inner)}]}}), json.dumps({"kwargs": inner, "cost": 0.5})]
    n, skipped, s = analyzed(spark, lines)
    assert (n, skipped, s["items"], s.dup_items) == (2, 0, 4, 2)


def test_models_keep_apart_and_rules_join(spark):
    two = [json.dumps({"model": m, "input": "same"}) for m in "ab"]
    assert analyzed(spark, two)[2].dup_items == 0
    spaced = [json.dumps({"model": "m", "input": t}) for t in ("a  b", " a b ")]
    assert analyzed(spark, spaced)[2].dup_items == 0
    assert analyzed(spark, spaced, "trim,collapse")[2].dup_items == 1


@pytest.mark.parametrize(
    ("shape", "n", "tokens"),
    [('"x"', 1, False), ('["a","b","c"]', 3, False), ("[1,2,3]", 1, True), ("[[1,2],[3]]", 2, True), ("[]", 0, False), ("7", 0, False), ('{"a":1}', 0, False), ("null", 1, False), ('["a",null]', 2, False), ("[1.5]", 0, False)],
)
def test_input_shapes(spark, shape, n, tokens):
    rows = requests.items(spark.createDataFrame([(shape,)], "input string")).collect()
    assert len(rows) == n and all(r.is_tokens is tokens for r in rows)


def test_identity(spark):
    df = spark.createDataFrame([("m", "1,2,3", [1, 2, 3])], "m string, t string, k array<long>")
    r = df.select(
        identity.text_key(F.col("m"), F.col("t")).alias("a"), identity.token_key(F.col("m"), F.col("k")).alias("b"), identity.text_key(F.lit("n"), F.col("t")).alias("c"), identity.text_key(F.col("m"), F.col("t"), F.lit(3)).alias("d")
    ).first()
    assert len(set(r)) == 4
    import hashlib

    assert r.b == hashlib.sha256(b"ec2\0m\x000\0\0\0t\0" + b"".join(i.to_bytes(8, "little") for i in (1, 2, 3))).hexdigest()


def test_params_digest(spark):
    rows = [({},), ({"b": "1", "a": "2"},), ({"a": "2", "b": "1"},), ({"a": "3", "b": "1"},)]
    d = [r[0] for r in spark.createDataFrame(rows, "p map<string,string>").select(identity.params_digest(F.col("p"))).collect()]
    assert d[0] == "" and d[1] == d[2] != d[3]


def test_raw_params_keep_spelling(spark):
    df = spark.createDataFrame([('{"model":"m","input":"x","t":1.50}',), ('{"model":"m","input":"x","t": 1.5 }',)], "r string")
    assert [r[0] for r in df.select(requests.raw_params("r")).collect()] == [{"t": "1.50"}, {"t": "1.5"}]


def test_normalisation_rules(spark):
    df = spark.createDataFrame([("é a̧",)], "t string")
    assert df.select(text.fold(F.col("t"))).first()[0] == "é a̧"
    with pytest.raises(ValueError):
        text.parse_rules("trim, stem")
    assert text.parse_rules(" ,collapse,nfc") == ("nfc", "collapse")


def test_token_estimates(spark):
    rows = spark.createDataFrame([("",), ("12345678",), ("漢" * 10,), ("a漢",)], "t string")
    assert [r[0] for r in rows.select(text.estimate_tokens(F.col("t"))).collect()] == [1, 2, 10, 2]


def test_preview(spark):
    rows = spark.createDataFrame([("a  b",), ("x" * 61,), ("é" * 40,)], "t string")
    got = [r[0] for r in rows.select(text.preview(F.col("t"))).collect()]
    assert got == ["a b", "x" * 57 + "...", "é" * 28 + "..."]


def test_encode_request(spark):
    df = spark.createDataFrame([("m", '["a"]', 0, "", "u", {"input_type": '"query"'})], "model string, input string, dimensions int, encoding_format string, user string, params map<string,string>")
    out = df.select(requests.encode_request("model", "input", "dimensions", "encoding_format", "user", "params")).first()[0]
    assert out == '{"input":["a"],"input_type":"query","model":"m","user":"u"}'


def test_odd_names_of_parameters(spark):
    odd = {'a"b': "1", "c\\d": "[2]", "tab\t\n\x01": '"x"', "é漢": "null", "": "true"}
    df = spark.createDataFrame([("m", '"x"', None, None, None, odd)], "model string, input string, dimensions int, encoding_format string, user string, params map<string,string>")
    line = df.select(requests.encode_request("model", "input", "dimensions", "encoding_format", "user", "params").alias("value"))
    assert json.loads(line.first().value) == {k: json.loads(v) for k, v in odd.items()} | {"model": "m", "input": "x"}
    again = requests.parse(requests.extract(line), line="value").first()
    assert again.params == odd and again.model == "m"


def log_of(spark, folder, texts):
    docs = [(i, t, "en") for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")


def test_keys_are_of_whole_texts(spark, tmp_path):
    from lodestone.plans.catalogue import QUERIES

    log_of(spark, tmp_path, {0: "x" * 200 + "a", 1: "x" * 200 + "b", 4: 'y"\\\n' * 50_000, 3: "x" * 200 + "c"})
    got = {(r.seq, r.pos): r.key for r in QUERIES["envelope_items_all"](spark, str(tmp_path)).collect()}
    assert set(got) == {(0, 0), (1, 0), (1, 1), (3, 0), (3, 1), (4, 0)}
    assert len({got[k] for k in ((0, 0), (1, 0), (3, 0), (4, 0))}) == 4
    want = spark.range(1).select(identity.text_key(F.lit("embed-en"), F.lit('y"\\\n' * 50_000))).first()[0]
    assert got[4, 0] == want


def test_nested_lines_get_a_status(spark, tmp_path):
    from lodestone.plans.catalogue import QUERIES

    log_of(spark, tmp_path, {i: "text" for i in range(10)})
    got = {r.seq: (r.status, r.n_items) for r in QUERIES["request_status_all"](spark, str(tmp_path)).collect()}
    assert got == {i: (400, 0) if i == 9 else (400, 2) if i % 4 in (1, 3) else (200, 1) for i in range(10)}


def test_known_fields_of_wrong_types_are_no_requests(spark):
    lines = ['{"model":5,"input":"x"}', '{"model":"m","input":"x","dimensions":"abc"}', '{"model":"m","input":"x","dimensions":1.0}', '{"model":"m","input":"x","user":7}', '{"model":"m"}', '{"model":"","input":"x"}']
    lines += ['{"body":{"model":5,"input":"x"}}', '{"a":{"model":"m","input":"x","encoding_format":1}}', '{"model":"m","input":"x","dimensions":null,"user":null}', '{"body":{"model":5,"input":"x"},"data":"{\\"model\\":\\"n\\",\\"input\\":[1]}"}']
    got = {r.seq: r.request for r in requests.extract(spark.createDataFrame(list(enumerate(lines)), "seq int, value string")).collect()}
    assert [i for i in got if got[i] is not None] == [8, 9] and json.loads(got[9])["model"] == "n"


def test_parameters_are_spelt_as_they_were(spark):
    rows = ['{"model":"m","input":"x","n":1}', '{"model":"m","input":"x","n":"1"}', '{"body":{"model":"m","input":"x","n": 1.50, "s":"a b"}}', '{"request":"{\\"model\\":\\"m\\",\\"input\\":\\"x\\",\\"n\\":1.5}"}']
    found = requests.parse(requests.extract(spark.createDataFrame(list(enumerate(rows)), "seq int, value string")), line="value")
    out = found.select("seq", "params", identity.params_digest(F.col("params")).alias("d"), requests.encode_request("model", "input", "dimensions", "encoding_format", "user", "params").alias("again")).orderBy("seq").collect()
    assert [r.params for r in out] == [{"n": "1"}, {"n": '"1"'}, {"n": "1.50", "s": '"a b"'}, {"n": "1.5"}]
    assert len({r.d for r in out}) == 4
    assert all(json.loads(r.again)["n"] is not None for r in out) and '"s":"a b"' in out[2].again


def test_lines_follow_the_order_of_the_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(f"a{i}" for i in range(3)) + "\n \n")
    (tmp_path / "b.jsonl").write_text("\n".join(f"b{i}" * 50 for i in range(40_000)))
    rows = requests.read_log(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).orderBy("seq").collect()
    assert [r.value[: len(f"b{i}")] for i, r in enumerate(rows[3:])] == [f"b{i}" for i in range(40_000)]
    assert [r.value for r in rows[:3]] == ["a0", "a1", "a2"] and [r.seq for r in rows] == [0, 1, 2, *range(4, 40_004)]


def test_lines_over_the_limit(spark, tmp_path):
    (tmp_path / "log").write_text("a\n" + "x" * 50 + "\nb\n")
    assert requests.read_log(spark, str(tmp_path / "log"), 50).count() == 3
    with pytest.raises(Exception, match="line 1 is longer than 49 bytes"):
        requests.read_log(spark, str(tmp_path / "log"), 49).collect()


def test_report_of_an_analysis(spark):
    from lodestone.operators import analyze

    one = {"model": "text-embedding-3-large", "input": ["hello  world", "hello  world", [1, 2][0:0] and None or "x"]}
    lines = [json.dumps(one), json.dumps({"model": "m", "input": [[1, 2, 3], [1, 2, 3]]}), "junk", " "]
    log = spark.createDataFrame([(i, s) for i, s in enumerate(lines) if s.strip()], "seq long, value string")
    summary, models, top = analyze.analyze(log)
    s = summary.first()
    assert (s.requests, s.skipped, s["items"], s.unique_items, s.dup_items, s.total_tokens, s.wasted_tokens) == (2, 1, 5, 3, 2, 13, 6)
    assert abs(s.total_usd - (7 * 0.13 + 6 * 0.02) / 1e6) < 1e-15 and abs(s.wasted_usd - (3 * 0.13 + 3 * 0.02) / 1e6) < 1e-15
    assert {r.preview for r in top.collect()} == {"hello world", "<3 pre-tokenized tokens>"}
    text_ = analyze.render(summary, top, models)
    assert "requests          2 (and 1 lines that are none)" in text_ and "<3 pre-tokenized tokens>" in text_
    whole = json.loads(analyze.as_json(summary, models, top).first().value)
    assert whole["requests"] == 2 and len(whole["models"]) == 2 and [t["wasted_tokens"] for t in whole["top_duplicates"]] == [3, 3]


def test_inputs_of_two_requests_with_other_dimensions_differ(spark):
    from lodestone.operators import analyze

    lines = [json.dumps({"model": "m", "input": "x"} | more) for more in ({}, {"dimensions": 8}, {"encoding_format": "base64"}, {"t": 1}, {"user": "u"})]
    rows = analyze.items(analyze.parsed(spark.createDataFrame(list(enumerate(lines)), "seq long, value string")))
    assert len({r.key for r in rows.collect()}) == 4


def test_lines_are_read_by_python_once(spark):
    """One call of Python for a line, also below a filter on what it gives, with the rows of extract and parse."""
    from lodestone.operators import analyze

    body = '{"model":"m","input":"x","t":1.50,"u":[1, 2]}'
    made = [body, '{"body":%s}' % body, '{"request":%s}' % json.dumps(body), '{"a":[{"b":%s}]}' % body, '{"a":{"model":"m","input":"x"}}', '{"model":"m","input":"x","at":7}', "junk", None, '{"model":5,"input":1}', '{"data":{"model":"n","input":["a"],"dimensions":3,"p":"q"}}']
    lines = spark.createDataFrame(list(enumerate(made)), "seq long, value string")
    columns = ["seq", "request", "model", "input", "dimensions", "encoding_format", "user", "params"]
    want = requests.parse(requests.extract(lines), ignore=("at",), line="value").select(columns)
    got = requests.read(lines, ignore=("at",)).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = analyze.parsed(lines).where("params IS NOT NULL AND model = 'm'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
