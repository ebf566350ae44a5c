import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.fixed_values import CODEBOOK
from glosswork.functions import coerce, hashing, names, numeric, text


def column(make, values, kind, fn):
    rows = make([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_text_to_number(make):
    given = [" 1 ", "1e3", "inf", "-Infinity", "True", "1d", "0x1F", "1_0", "", "nan", "-", "1,000", None, ".5", "+2.", " 7"]
    want = [1.0, 1000.0, math.inf, -math.inf, None, None, None, None, None, None, None, None, None, 0.5, 2.0, 7.0]
    assert column(make, given, "string", coerce.text_to_number) == want


def test_null_tokens(make):
    given = ["NA", "N/A", "NULL", "null", "NaN", "nan", "None", "n/a", "<NA>", "#N/A", "", "none", "-", "x"]
    assert column(make, given, "string", coerce.clear_null_tokens) == [None] * 11 + ["none", "-", "x"]


def test_word_flag(make):
    given = [" TRUE", "no ", "Recommended", "not recommended", "none", "", "1", None]
    assert column(make, given, "string", coerce.word_flag) == [1.0, 0.0, 1.0, 0.0, None, None, None, None]


def test_to_number_by_type(make):
    assert column(make, [True, False, None], "boolean", lambda c: coerce.to_number(c, T.BooleanType())) == [1.0, 0.0, None]
    assert column(make, [1.5, math.nan], "double", lambda c: coerce.to_number(c, T.DoubleType())) == [1.5, None]
    with pytest.raises(PySparkException, match="not a number"):
        column(make, ["1", "x"], "string", lambda c: coerce.to_number(c, T.StringType(), "raise", "Rating"))


def test_clamp(make):
    got = column(make, [7.0, 0.0, math.nan, None, 3.5], "double", numeric.clamp)
    assert got[:2] == [5.0, 1.0] and math.isnan(got[2]) and got[3:] == [None, 3.5]


def test_number_texts(make):
    assert column(make, [1.23456, -2.0], "double", numeric.value_text) == ["1.2346", "-2.0000"]
    assert column(make, [1.0], "double", lambda c: numeric.value_text(c, True)) == ["1"]
    assert column(make, [0.12345, -0.5], "double", numeric.signed_text) == ["+0.123", "-0.500"]
    assert column(make, [0.0, -0.1], "double", numeric.sign_class) == ["pos", "neg"]


def test_names(make):
    given = ["x_present", "age", "llm_fit", "llm__polarity", "T10_EMOTIONAL_INTENSITY"]
    assert column(make, given, "string", names.prefix_display) == [
        "llm_x_present", "age", "llm_fit", "llm__polarity", "T10_EMOTIONAL_INTENSITY"]
    assert column(make, ["llm_fit_polarity", "size_llm_intensity", "Age_group"], "string",
                  lambda c: names.clean_display(c, names.is_derived(c))) == ["llm fit polarity", "llm size intensity", "Age group"]
    assert names.is_derived_name("a_intensity") and not names.is_derived_name("T10_EMOTIONAL_INTENSITY")
    assert names.is_theme_name("T1_X") and not names.is_theme_name("Title")


def test_rule_feature(make):
    given = ["0.00 < llm_age <= 1.00", "AGE > 3", "size <= 2.00"]
    got = column(make, given, "string", lambda c: names.rule_feature(c, ["age", "age2"], ["age", "llm_age"]))
    assert got == ["age2", "age", "size <= 2.00"]


def test_review_text_and_prompt(make):
    rows = make([("a", "b"), (None, None), (None, " x ")], "t string, r string")
    built = [r[0] for r in rows.select(text.review_text(F.col("t"), F.col("r"))).collect()]
    assert built == ["Title: a | Review: b", "Title:  | Review:", "Title:  | Review:  x"]
    assert column(make, ["", "Title:  | Review:", "x"], "string", text.is_empty_review) == [True, True, False]
    assert len(column(make, ["y" * 3000], "string", lambda c: text.review_text(c, c))[0]) == len("Title:  | Review: ") + 6000
    assert len(column(make, ["y" * 3000], "string", lambda c: text.review_text(c, c, 1000))[0]) == 1000
    asked = column(make, ["T"], "string", text.prompt)[0]
    assert asked.startswith("You are a qualitative research assistant") and asked.endswith("Review:\nT")
    assert all(f'  "{k}": "{v}"' in asked for k, v in CODEBOOK.items())


def test_json_slice(make):
    given = ['ok: {"a":{"b":1}} done', "} {", "none", "{}", "{", "}"]
    assert column(make, given, "string", text.json_slice) == ['{"a":{"b":1}}', None, None, "{}", None, None]


@pytest.mark.parametrize("value, want", [
    ("1", 1), ('"1"', 1), ("1.9", 1), ('"1.0"', 0), ("true", 1), ("false", 0), ("null", 0), ("2", 0), ("-1", 0),
    ('" 1 "', 1), ('"+1"', 1), ("1e0", 1), ("[1]", 0), ('{"x": 1}', 0), ('"yes"', 0), ("10", 0), ("0.99", 0)])
def test_theme_value(make, value, want):
    got = column(make, [f'So: {{"k": {value}, "o": 0}}'], "string", lambda c: text.theme_value(text.parsed_answer(c), "k"))
    assert got == [want]


def test_theme_value_missing(make):
    assert column(make, ['{"o": 1}', "refused", '{"k": 1'], "string",
                  lambda c: text.theme_value(text.parsed_answer(c), "k")) == [0, 0, 0]


def test_hash_draws(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "row_key")
    got = ids.agg(F.avg(hashing.is_test("row_key").cast("int")), F.avg(hashing.poisson_weight("row_key", 43)),
                  F.var_pop(hashing.poisson_weight("row_key", 43)), F.avg(hashing.uniform("row_key", 1))).first()
    assert abs(got[0] - 0.2) < 0.01 and abs(got[1] - 1) < 0.03 and abs(got[2] - 1) < 0.05 and abs(got[3] - 0.5) < 0.01
    assert ids.where("row_key < 1000").where(hashing.is_test("row_key")).count() == 182
