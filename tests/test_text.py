"""Column functions on golden values."""

import pytest
from pyspark.sql import functions as F

from weft.functions import text, vectors


def one(spark, value, make, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(make("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw",
    ["  a b ", "\ta\u00a0", "\u3000x ", "\x1cq\x1f", "", "   ", "a"],
)
def test_strip_and_tokens_follow_python(spark, raw):
    assert one(spark, raw, text.strip) == raw.strip()
    assert one(spark, raw, text.split_ws) == raw.split()


def test_single_space_tokens(spark):
    assert one(spark, "", text.split_space) == [""]
    assert one(spark, "a  b", text.split_space) == ["a", "", "b"]


def test_chars_are_code_points(spark):
    assert one(spark, "aß😀b", text.split_chars) == ["a", "ß", "😀", "b"]


def test_field(spark):
    assert one(spark, "a\tb\tc", lambda c: text.field(c, 1)) == "b"
    assert one(spark, "a|b", lambda c: text.field(c, 1, "|")) == "b"
    with pytest.raises(Exception, match="no field 3"):
        one(spark, "a\tb", lambda c: text.field(c, 3))


@pytest.mark.parametrize(
    "raw, code, sent",
    [
        ("<c5><eoc>hi</s>", "<c5>", "hi"),
        ("hi</s>", None, "hi</s>"),
        ("a<eoc>b<eoc>c", None, "a<eoc>b<eoc>c"),
        ("NULL<eoc>x</s>", None, "x"),
        ("<eoc>", "", ""),
    ],
)
def test_split_code(spark, raw, code, sent):
    assert tuple(one(spark, raw, text.split_code)) == (code, sent)


@pytest.mark.parametrize(
    "raw, normal",
    [
        ("(ROOT (S (.)))", "(ROOT (S (. .)))"),
        ("(NN dogs dog)", "(NN dogs)"),
        (" (NN dogs)\n", "(NN dogs)"),
        ("(NP (NN a b) (NN c d))", "(NP (NN a) (NN c))"),
    ],
)
def test_normalise_brackets(spark, raw, normal):
    assert one(spark, raw, text.normalise_brackets) == normal


def test_codes(spark):
    bits = one(spark, [0.5, -1.0, 2.0, 0.0, -3.0, 1.0, -0.1, 0.0], lambda c: vectors.binarise(c, 8), "x array<double>")
    assert bits == [1, 0, 1, 0, 0, 1, 0, 0]
    assert one(spark, bits, vectors.pack_bits, "x array<int>") == 37
    assert one(spark, "37", text.code_tokens) == "<c38>"
    assert one(spark, "3  0", text.code_tokens) == "<c4> <c1>"
    merged = one(spark, "target", lambda c: text.with_code(F.lit("<c38>"), c))
    assert merged == "<c38> <eoc> target"


def test_saturating_sigmoid(spark):
    for x, y in ((0.0, 0.5), (10.0, 1.0), (-10.0, 0.0)):
        assert abs(one(spark, x, vectors.saturating_sigmoid, "x double") - y) < 1e-12


def test_first_maximum_wins(spark):
    assert one(spark, [1.0, 3.0, 3.0], vectors.argmax, "x array<double>") == 1


def test_wrap_and_crop(spark):
    assert one(spark, ["a"], text.wrap, "x array<string>") == ["<s>", "a", "</s>"]
    assert len(one(spark, ["a"] * 200, text.crop, "x array<string>")) == 150


@pytest.mark.parametrize("number, name", [(0, "00"), (7, "07"), (42, "42"), (123, "123")])
def test_shard_name(spark, number, name):
    assert one(spark, number, text.shard_name, "x bigint") == name


@pytest.mark.parametrize(
    "raw, tokens",
    [
        ('He said, "Hi."', ["he", "said", ",", '"', "hi", ".", '"']),
        ("3.14 and 1,000.", ["3.14", "and", "1,000", "."]),
        ("a-b 5-6", ["a-b", "5", "-", "6"]),
        ("&quot;x&quot; &amp; y's", ['"', "x", '"', "&", "y's"]),
        ("", []),
    ],
)
def test_tokens_13a(spark, raw, tokens):
    assert one(spark, raw, text.tokens_13a) == tokens


@pytest.mark.parametrize(
    "raw, lang, out",
    [
        ("“Hi” ( there )…", "en", '"Hi" (there)...'),
        ("12\u00a0345", "de", "12,345"),
        ("12\u00a0345", "en", "12.345"),
        ('"so",', "en", '"so,"'),
        ('"so",', "de", '"so",'),
    ],
)
def test_normalise(spark, raw, lang, out):
    assert one(spark, raw, lambda c: text.normalise(c, F.lit(lang))) == out


@pytest.mark.parametrize(
    "raw, lang, out",
    [
        ("it's well-known, 3.5!", "en", "it 's well @-@ known , 3.5 !"),
        ("l'eau", "fr", "l' eau"),
        ("o'x", "de", "o ' x"),
        ("a-b-c.", "en", "a @-@ b @-@ c ."),
    ],
)
def test_tokenise(spark, raw, lang, out):
    assert one(spark, raw, lambda c: text.tokenise(c, F.lit(lang))) == out
