import json
import math

import pytest
from pyspark.sql import functions as F

from driftloom.functions import actions as A
from driftloom.functions.text import json_string, str_or_none, strip, unquoted
from driftloom.operators.parsing import filled, first_object, lcs_length, parse


def one(spark, **columns):
    row = {k: v for k, v in columns.items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


@pytest.mark.parametrize(
    "raw, expect",
    [
        (("click", "product_link", "nav.item", None), ("click", "product_link", "nav.item", None, True)),
        (("CLICK", None, " ", None), ("click", None, None, None, True)),
        (("input", "purchase", "box", "some text"), ("input", None, "box", "some text", True)),
        (("terminate", None, "x", "y"), ("terminate", None, None, None, True)),
        (("scroll", None, "x", None), ("scroll", None, None, None, False)),
        (("click", "no_such", "x", None), ("click", "no_such", "x", None, False)),
        ((None, None, "x", None), (None, None, None, None, False)),
        ((" click", None, "x", None), (" click", None, None, None, False)),
    ],
)
def test_normalised(spark, raw, expect):
    df = one(spark, t=raw[0], c=raw[1], s=raw[2], i=raw[3])
    f = A.normalised(F.col("t"), F.col("c"), F.col("s"), F.col("i"))
    assert tuple(df.select(*[v.alias(k) for k, v in f.items()]).first()) == expect


TEXTS = ["", "plain", 'quo"te', "back\\slash", "tab\tline\n", "é 日本 🙂", "\x01\x0b\x1e\x1f\x7f", "a/b", " ", None]


@pytest.mark.parametrize("text", TEXTS)
def test_json_forms_are_pythons(spark, text):
    df = one(spark, x=text)
    out = df.select(json_string(F.col("x")), A.internal_json(F.lit("click"), F.lit("review"), F.col("x"), F.lit(None).cast("string")), A.wire_json(F.lit("input"), F.lit("n"), F.col("x")), A.completion(F.col("x"), F.lit('{"type": "terminate"}'))).first()
    dump = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True)
    assert out[0] == dump(text)
    assert out[1] == dump({"click_type": "review", "name": text, "type": "click"})
    assert out[2] == dump({"name": "n", "text": text, "type": "input"})
    assert out[3] == dump({"action": {"type": "terminate"}, "rationale": (text or "").strip()})


@pytest.mark.parametrize("text", ["  a ", "\xa0a ", "", " ", None, "a b"])
def test_strip(spark, text):
    got = one(spark, x=text).select(strip(F.col("x")), str_or_none(F.col("x"))).first()
    assert got[0] == (text.strip() if text is not None else None)
    assert got[1] == (text if text and text.strip() else None)


@pytest.mark.parametrize("text, expect", [('"a b"', "a b"), ("'x'", "x"), ('"', ""), ('"a', '"a'), (" ' y ' ", "y"), ("z", "z")])
def test_unquoted(spark, text, expect):
    assert one(spark, x=text).select(unquoted(F.col("x"))).first()[0] == expect


@pytest.mark.parametrize(
    "p, g, expect",
    [
        (("click", "a", None), ("click", " a ", None), True),
        (("click", "A", None), ("click", "a", None), False),
        (("click", None, None), ("click", " ", None), True),
        (("input", "a", "x  y"), ("input", "a", "x y"), False),
        (("input", "a", "x"), ("input", "a", "x "), True),
        (("terminate", "a", None), ("terminate", "b", None), True),
        (("click", "a", None), ("input", "a", None), False),
        ((None, None, None), ("terminate", None, None), False),
    ],
)
def test_matches(spark, p, g, expect):
    df = one(spark, p_type=p[0], p_name=p[1], p_text=p[2], g_type=g[0], g_name=g[1], g_text=g[2])
    assert df.select(A.matches("p_", "g_")).first()[0] is expect


def scored(spark, completion, gt, **options):
    r = parse(completion)
    df = spark.createDataFrame(
        [(r["ok"], r["rationale"], r["type"], r["name"], r["text"], gt.get("type"), gt.get("click_type"), gt.get("name"), gt.get("text"))],
        "ok boolean, said string, pred_type string, pred_name string, pred_text string, gt_type string, gt_click_type string, gt_name string, gt_text string",
    )
    metrics = A.step_metrics(F.col("ok"))
    row = df.select(A.reward(F.col("ok"), F.col("said"), **options), *metrics.values()).first()
    return round(row[0], 6), tuple(row[1:])


def said(action, rationale="because"):
    return json.dumps({"rationale": rationale, "action": action})


@pytest.mark.parametrize("kind", A.CLICK_TYPES)
def test_reward_of_each_click_type(spark, kind):
    gt = {"type": "click", "click_type": kind, "name": "a"}
    weight = {"product_option": 10, "review": 1, "search": 1}.get(kind, 1000)
    assert scored(spark, said({"type": "click", "name": "a"}), gt)[0] == round(weight + 0.1, 6)


def test_reward_cases(spark):
    gt = {"type": "click", "click_type": "purchase", "name": "a"}
    assert scored(spark, "no json", gt) == (0.0, (0, 0, 0, 0))
    assert scored(spark, said({"type": "click", "name": "b"}), gt) == (-0.9, (1, 1, 1, 0))
    assert scored(spark, said({"type": "click", "name": "b"}, " "), gt)[0] == -1.0
    assert scored(spark, said({"type": "click", "name": "b"}), gt, rl_only=True)[0] == 0.1
    assert scored(spark, said({"type": "terminate"}), gt) == (0.1, (1, 0, 0, 0))
    assert scored(spark, said({"type": "click", "name": "a"}), gt, overrides={"purchase": 5000})[0] == 5000.1
    assert scored(spark, said({"type": "input", "name": "q", "text": "t"}), {"type": "input", "name": "q", "text": "t"}) == (2000.1, (1, 1, 1, 1))
    assert scored(spark, said({"type": "terminate"}), {"type": "terminate"}) == (1.1, (1, 1, 1, 1))
    # absent names are alike for the reward; the metric also wants the slot filled
    assert scored(spark, said({"type": "click"}), {"type": "click", "click_type": None}) == (1000.1, (1, 1, 0, 0))


@pytest.mark.parametrize(
    "text, expect",
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": {"b": "}"}}\n``` later ```{"z": 1}```', {"a": {"b": "}"}}),
        ('so: {"a": "x } \\" {"} done {"b": 2}', {"a": 'x } " {'}),
        ('{"a": oops} {"b": 2}', None),
        ('{"a": "open', None),
        ("", None),
        ("} {", None),
    ],
)
def test_first_object(text, expect):
    assert first_object(text) == expect


def test_parse_cases():
    assert parse(said({"type": " Click ", "name": "n", "click_type": "purchase"}))["click_type"] == "purchase"
    assert parse('{"rationale": null, "action": {"type": "terminate"}}')["rationale"] == "None"
    for bad in ('{"action": 3}', '{"x": 1}', said({"type": "hover"}), said({"type": "click", "click_type": "nope"}), "[1]", None):
        assert parse(bad)["ok"] is False
    assert filled(math.nan) is None and filled(" ") is None and filled(3) == "3"


def test_lcs():
    assert lcs_length(list("abcbdab"), list("bdcaba")) == 4 and lcs_length([], list("a")) == 0
