"""Scalar types of metrics: inference, coercion and tightening.

A metric has one type for its whole life, `jsonl` or a numeric tag. Integers
keep their exact value in DECIMAL(20,0), which holds all of u64.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

JSON = "jsonl"


@dataclass(frozen=True)
class Kind:
    """A numeric tag: bytes of a stored value, numpy's little-endian code, Spark's type."""

    width: int
    code: str
    spark: str


# fixed values of the storage format
KINDS = {
    "f32": Kind(4, "<f4", "float"),
    "f64": Kind(8, "<f8", "double"),
    "i8": Kind(1, "<i1", "tinyint"),
    "i16": Kind(2, "<i2", "smallint"),
    "i32": Kind(4, "<i4", "int"),
    "i64": Kind(8, "<i8", "bigint"),
    "u8": Kind(1, "<u1", "smallint"),
    "u16": Kind(2, "<u2", "int"),
    "u32": Kind(4, "<u4", "bigint"),
    "u64": Kind(8, "<u8", "decimal(20,0)"),
}
UNSIGNED, SIGNED = ("u8", "u16", "u32", "u64"), ("i8", "i16", "i32", "i64")
#: Largest step.
LAST_STEP = 0xFFFFFFFF


def bounds(tag: str) -> tuple[int, int]:
    """Least and largest value of an integer tag."""
    bits = 8 * KINDS[tag].width
    return (0, 2**bits - 1) if tag[0] == "u" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)


def infer(value: Any) -> str:
    """The tag that a metric gets from its first value.

    Numpy scalars keep their width, Python floats are f32, ints i64; booleans,
    text, lists, objects and None are JSON. An array that is no scalar raises.
    """
    if hasattr(value, "__array__"):
        array = np.asarray(value)
        if array.shape != ():
            raise ValueError(f"only scalars can be stored, not shape {array.shape}")
        tag = f"{array.dtype.kind}{8 * array.dtype.itemsize}"
        return tag if tag in KINDS else JSON
    if isinstance(value, bool):
        return JSON
    if isinstance(value, float):
        return "f32"
    return "i64" if isinstance(value, int) else JSON


def coerce(value: Any, tag: str) -> Any:
    """The value as it is stored under a tag: a float, an int, or JSON text.

    Values that a tag can't hold raise; they are never wrapped or dropped. Floats
    are cut off towards zero for integer tags, None is NaN for floating ones.
    """
    if tag == JSON:
        if hasattr(value, "tolist"):
            if np.asarray(value).shape != ():
                raise ValueError("only scalars can be stored")
            value = value.tolist()
        return json.dumps(value, ensure_ascii=False)
    array = np.asarray(value)
    if array.shape != ():
        raise ValueError(f"only scalars can be stored, not shape {array.shape}")
    if tag[0] == "f":
        return float(np.float32(np.float64(np.nan if value is None else value))) if tag == "f32" else float(np.nan if value is None else value)
    whole = int(array.item()) if not isinstance(array.item(), str) else int(float(array.item()))
    low, high = bounds(tag)
    if not low <= whole <= high:
        raise OverflowError(f"{whole} is out of range for {tag}")
    return whole


def tightest(low: int, high: int) -> str:
    """The smallest integer tag that holds low to high; unsigned if nothing is negative."""
    for tag in UNSIGNED if low >= 0 else SIGNED:
        if bounds(tag)[0] <= low and high <= bounds(tag)[1]:
            return tag
    raise OverflowError(f"{low} to {high} fits no integer type")


def tightest_sql(low: Column, high: Column) -> Column:
    """`tightest` of two columns; null where one is null or nothing fits."""
    fits = F.when(low.isNull() | high.isNull(), F.lit(None))
    for tags, sign in ((UNSIGNED, low >= 0), (SIGNED, low < 0)):
        for tag in tags:
            fits = fits.when(sign & (low >= F.lit(bounds(tag)[0]).cast("decimal(20,0)")) & (high <= F.lit(str(bounds(tag)[1])).cast("decimal(20,0)")), F.lit(tag))
    return fits


#: What JSON values of a metric are, as the whole-column inference sees them.
FLOAT, INT, BOOL, OTHER = "float", "int", "bool", "other"


def json_kind(value: Any) -> str:
    if isinstance(value, bool):
        return BOOL
    return INT if isinstance(value, int) else FLOAT if isinstance(value, float) else OTHER


def infer_column(kinds: Column, low: Column, high: Column, first: Column) -> Column:
    """The tag of a whole column of JSON values.

    `kinds` is the set of their kinds, `low` and `high` bound the integers and
    `first` is the tag of the first value. All floats are f32, integers (also
    mixed with booleans) the tightest, integers and floats f64, booleans alone
    JSON; anything else has the tag of the first value.
    """
    has = lambda kind: F.array_contains(kinds, kind)
    numbers = has(FLOAT) | has(INT)
    return (
        F.when(has(OTHER) | ~numbers, first)
        .when(has(FLOAT) & (has(INT) | has(BOOL)), F.lit("f64"))
        .when(has(FLOAT), F.lit("f32"))
        .otherwise(F.coalesce(tightest_sql(F.least(low, F.when(has(BOOL), F.lit(0).cast("decimal(20,0)")).otherwise(low)), F.greatest(high, F.when(has(BOOL), F.lit(1).cast("decimal(20,0)")).otherwise(high))), first))
    )
