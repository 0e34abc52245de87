"""Lenient parsing rules, hashing and file names."""

import math

import pytest
from pyspark.sql import functions as F

from gavel.functions import hashing, text, verdicts


def evaluate(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(function(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_lenient_int(spark):
    tokens = ["2024", "2024.0", "2e3", "2024.0000000001", None, "", "-7", "2024.5", "abc", "true", "inf", " 5"]
    assert evaluate(spark, text.lenient_int, tokens) == [
        2024, 2024, 2000, 2024, 0, 0, -7, None, None, None, None, None,
    ]


FLOATS = ["1", "0.5", " 1e0 ", "1_0", "100f", "1d", "", "nan", "-inf", "Infinity", "1__0", "_1", ".5", "5.", "1e", " 7\n", "0x10"]


def test_python_float_is_pythons(spark):
    got = evaluate(spark, text.python_float, FLOATS)
    for token, value in zip(FLOATS, got):
        try:
            want = float(token)
        except ValueError:
            want = None
        assert value == want or (want is not None and math.isnan(want) and math.isnan(value)), token


def test_python_int_is_pythons(spark):
    tokens = ["5", " +5 ", "-3", "1_000", "1__0", "1.0", "", "x", "9223372036854775807"]
    want = []
    for token in tokens:
        try:
            want.append(int(token))
        except ValueError:
            want.append(None)
    assert evaluate(spark, text.python_int, tokens) == want


def plain_fnv(key: str) -> int:
    h = 0xCBF29CE484222325
    for byte in key.encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_fnv_matches_the_definition(spark):
    keys = ["", "1:A", "1850:F2", "77:Ж", "x" * 300, "12:日本"]
    assert evaluate(spark, hashing.fnv1a64, keys) == [plain_fnv(k) for k in keys]


def test_float32(spark):
    assert evaluate(spark, text.float32, [0.1], "double") == [0.10000000149011612]


@pytest.mark.parametrize(
    "name, safe",
    [("a.cpp", True), ("", False), ("a/b", False), ("a\\b", False), (".", False), ("..", False), ("...", True)],
)
def test_safe_names(spark, name, safe):
    assert evaluate(spark, text.is_safe_file_name, [name]) == [safe]


def test_status_names(spark):
    names = evaluate(spark, verdicts.run_status_name, [0, 3, 7, 8, -1, None], "int")
    assert names == ["Normal", "Memory Limit Exceeded", "Fatal Error", "Unknown", "Unknown", "Unknown"]
