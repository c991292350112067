"""Reading one metric: ranges of steps, positions or values, then one point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions.types import JSON, KINDS
from runweave.operators.points import typed_value, with_pos


@dataclass(frozen=True)
class Selector:
    """At most one family of bounds. Steps and values include both ends, positions exclude `istop`."""

    start: float | None = None
    stop: float | None = None
    istart: int | None = None
    istop: int | None = None
    vstart: float | None = None
    vstop: float | None = None

    @property
    def family(self) -> str | None:
        given = [name for name, bounds in (("step", (self.start, self.stop)), ("position", (self.istart, self.istop)), ("value", (self.vstart, self.vstop))) if any(b is not None for b in bounds)]
        if len(given) > 1:
            raise ValueError(f"ranges of {' and '.join(given)} can't be mixed")
        return given[0] if given else None

    def predicate(self, dtype: str) -> Column | None:
        """The condition on points of a metric, in columns that Parquet can filter by; None for all."""
        family = self.family
        if family is None:
            return None
        if family == "step":
            return _between(F.col("step"), self.start, self.stop)
        if family == "position":
            if (self.istart or 0) < 0 or (self.istop or 0) < 0:
                raise ValueError("positions can't be negative")
            low = None if self.istart is None else F.col("pos") >= int(self.istart)
            high = None if self.istop is None else F.col("pos") < int(self.istop)
            return low & high if low is not None and high is not None else high if low is None else low
        if dtype == JSON:
            raise TypeError("values of a JSON metric have no order to select by")
        if dtype[0] == "f":
            # a 32-bit metric is compared in 32 bits; NaN is in no range
            cast = (lambda b: F.lit(b).cast("float").cast("double")) if dtype == "f32" else (lambda b: F.lit(float(b)))
            return _between(F.col("num"), self.vstart, self.vstop, cast) & ~F.isnan("num")
        exact = lambda b: F.lit(str(int(b))).cast("decimal(20,0)") if float(b).is_integer() and abs(b) < 10**19 else F.lit(float(b))
        return _between(F.col("ival"), self.vstart, self.vstop, exact)


def _between(column: Column, low, high, cast=F.lit) -> Column:
    out = F.lit(True) if low is None else column >= cast(low)
    return out if high is None else out & (column <= cast(high))


def metric(points: DataFrame, name: str, dtype: str, run: str | None = None, **bounds) -> DataFrame:
    """(pos, step, value) of a metric within a range, `value` in the metric's type.

    `points` has one run, or `run` names one. Rows are in no order; sort by pos
    where it matters. Unknown dtypes, mixed or negative ranges raise here.
    """
    if dtype != JSON and dtype not in KINDS:
        raise ValueError(f"unknown dtype {dtype}")
    rows = points.where(F.col("metric") == name)
    if run is not None:
        rows = rows.where(F.col("run") == run)
    condition = Selector(**bounds).predicate(dtype)
    if condition is not None:
        rows = rows.where(condition)
    return rows.select("pos", "step", typed_value(dtype).alias("value"))


def pick(selected: DataFrame, idx: int) -> DataFrame:
    """The one row at place `idx` of what was selected, negative from the end; none if out of range.

    Only the ends are sorted for: idx + 1 rows are kept by each task.
    """
    order = F.col("pos").asc() if idx >= 0 else F.col("pos").desc()
    place = idx if idx >= 0 else -idx - 1
    return selected.orderBy(order).limit(place + 1).offset(place)


def pick_many(selected: DataFrame, idx: slice | list[int]) -> DataFrame:
    """The rows at places of what was selected, by a slice or a list; IndexError if one of a list is out of range.

    Places are found range by range, so a long metric is spread over tasks. A
    row comes once and in no order, whatever the order of the places.
    """
    n = selected.count()
    ranked = with_pos(selected.withColumnRenamed("pos", "__pos").withColumn("__all", F.lit(0)), ("__all",), "__pos")
    place = F.col("pos")
    if isinstance(idx, slice):
        found = range(n)[idx]
        found = found if found.step > 0 else found[::-1]
        chosen = (place >= found.start) & (place < found.stop) & ((place - found.start) % found.step == 0)
    else:
        if any(not -n <= i < n for i in idx):
            raise IndexError(f"not all of {list(idx)[:9]} are among {n} rows")
        chosen = place.isin([i % n for i in idx]) if len(idx) else F.lit(False)
    return ranked.where(chosen).select(F.col("__pos").alias("pos"), "step", "value")
