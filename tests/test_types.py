import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.functions import types as t


def test_inference_from_the_first_value():
    assert [t.infer(v) for v in (1.5, 3, True, "x", None, [1], {"a": 1}, np.float64(1), np.float32(1), np.uint8(3), np.bool_(1), np.float16(1), np.array(2), np.str_("x"))] == ["f32", "i64", "jsonl", "jsonl", "jsonl", "jsonl", "jsonl", "f64", "f32", "u8", "jsonl", "jsonl", "i64", "jsonl"]
    with pytest.raises(ValueError):
        t.infer(np.zeros(2))


def test_coercion():
    assert t.coerce(1.9, "i64") == 1 and t.coerce(True, "f32") == 1.0 and math.isnan(t.coerce(None, "f32")) and t.coerce("1.5", "f32") == 1.5
    assert t.coerce(0.1, "f32") == float(np.float32(0.1)) and t.coerce(np.float64(0.1), "f64") == 0.1 and t.coerce(2**64 - 1, "u64") == 2**64 - 1
    assert t.coerce({"é": [1]}, "jsonl") == '{"é": [1]}' and json.loads(t.coerce(np.bool_(True), "jsonl")) is True
    for value, tag in ((300, "u8"), (-1, "u64"), (2**63, "i64")):
        with pytest.raises(OverflowError):
            t.coerce(value, tag)
    for value, tag in ((np.zeros(2), "f32"), (np.zeros(2), "jsonl"), ("x", "f32"), ([1, 2], "i64")):
        with pytest.raises(ValueError):
            t.coerce(value, tag)


CASES = [(0, 0, "u8"), (0, 255, "u8"), (0, 256, "u16"), (1, 65536, "u32"), (0, 2**32, "u64"), (0, 2**64 - 1, "u64"), (-1, 0, "i8"), (-129, 0, "i16"), (-1, 128, "i16"), (-1, 2**31, "i64"), (-(2**63), 2**63 - 1, "i64")]


def test_tightening(spark):
    assert [t.tightest(a, b) for a, b, _ in CASES] == [tag for *_, tag in CASES]
    with pytest.raises(OverflowError):
        t.tightest(-1, 2**63)
    frame = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b, _) in enumerate(CASES)] + [(99, None, None), (100, "-1", str(2**63))], "i int, a string, b string")
    got = {r["i"]: r["t"] for r in frame.select("i", t.tightest_sql(F.col("a").cast("decimal(20,0)"), F.col("b").cast("decimal(20,0)")).alias("t")).collect()}
    assert got == {i: tag for i, (*_, tag) in enumerate(CASES)} | {99: None, 100: None}
