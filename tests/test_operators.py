"""Operators against small models, at range sizes that cut metrics into many pieces."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from runweave.operators import merge, monotonic, points, rewind, segments
from runweave.operators.select import Selector, metric, pick, pick_many

POINT = points.SCHEMA


def series(spark, of, dtype="f64"):
    """Points of {metric: [(step, value), ...]}."""
    rows = [("r", m, i, s, dtype, float(v) if dtype[0] == "f" else None, Decimal(v) if dtype[0] in "iu" else None, v if dtype == "jsonl" else None) for m, found in of.items() for i, (s, v) in enumerate(found)]
    return spark.createDataFrame(rows, POINT)


def greedy(steps):
    out, i = [], 0
    while i < len(steps):
        if i == len(steps) - 1:
            out.append((steps[i], steps[i] + 1, 1))
            break
        stride, j = steps[i + 1] - steps[i], i + 1
        while j + 1 < len(steps) and steps[j + 1] - steps[j] == stride:
            j += 1
        out.append((steps[i], steps[j] + stride, stride))
        i = j + 1
    return out


@pytest.mark.parametrize("rows", [2, 7, 10**6])
def test_segments_against_the_greedy_model(spark, rows):
    rng = random.Random(rows)
    of = {f"m{i}": [(s, 0) for s in sorted(rng.sample(range(40), rng.randrange(1, 14)))] for i in range(120)}
    of |= {"run": [(s, 0) for s in range(0, 90, 3)], "two": [(s, 0) for s in (5, 80, 300, 520, 740)]}
    got: dict = {}
    for r in segments.segment(series(spark, of), rows).collect():
        got.setdefault(r["metric"], []).append((r["start"], r["stop"], r["stride"]))
    assert {m: sorted(v) for m, v in got.items()} == {m: greedy([s for s, _ in v]) for m, v in of.items()}
    assert sorted(got["two"]) == [(5, 155, 75), (300, 960, 220)]


def test_segment_thresholds_tails_and_truncation(spark):
    of = {"irregular": [(s, 0) for s in (3, 4, 9, 11, 30, 31, 50, 58, 70, 77)], "one": [(4, 0)], "even": [(s, 0) for s in (0, 1, 2)]}
    found = segments.segment(series(spark, of))
    assert {r["metric"]: r["mode"] for r in segments.index_mode(found).collect()} == {"irregular": "indices", "one": "indices", "even": "segments"}
    open_ = spark.createDataFrame([("r", "a", 0, 4, 2), ("r", "a", 10, None, 5), ("r", "b", 3, None, 1)], "run string, metric string, start long, stop long, stride long")
    counts = spark.createDataFrame([("r", "a", 5), ("r", "b", 0)], "run string, metric string, n long")
    assert sorted((r["start"], r["stop"]) for r in segments.close_tail(open_, counts).collect()) == [(0, 4), (10, 25)]
    cut = segments.truncate(spark.createDataFrame([("r", "a", 0, 20, 5), ("r", "a", 30, 60, 10)], "run string, metric string, start long, stop long, stride long"), 31)
    assert sorted((r["start"], r["stop"], r["stride"]) for r in cut.collect()) == [(0, 20, 5), (30, 40, 10)]
    with pytest.raises(ValueError):
        segments.validated([{"start": 0, "step": 1}, {"start": 5, "step": 1}])
    with pytest.raises(ValueError):
        segments.validated([{"start": 5, "stop": 9, "step": 1}, {"start": 8, "stop": 9, "step": 1}])


@pytest.mark.parametrize("rows", [2, 10**6])
def test_monotonic_against_a_model(spark, rows):
    rng = random.Random(1)
    of = {f"m{i}": [(s, rng.choice([math.nan] + [1, 2] * 8 + [rng.choice([s, -s])] * 9)) for s in range(rng.randrange(1, 9))] for i in range(200)}
    of |= {"flat": [(i, 2) for i in range(9)], "up": [(i, i) for i in range(9)], "down": [(i, -i) for i in range(9)], "nan": [(0, math.nan)]}

    def model(values):
        if any(math.isnan(v) for v in values):
            return None
        pairs = list(zip(values, values[1:], strict=False))
        return "inc" if all(a <= b for a, b in pairs) else "dec" if all(a >= b for a, b in pairs) else None

    got = {r["metric"]: r["monotonic"] for r in monotonic.direction(series(spark, of), rows).collect()}
    assert got == {m: model([v for _, v in found]) for m, found in of.items()}
    big = series(spark, {"big": [(0, 2**64 - 2), (1, 2**64 - 1)]}, "u64")
    assert [r["monotonic"] for r in monotonic.direction(big).collect()] == ["inc"]
    assert [r["monotonic"] for r in monotonic.direction(series(spark, {"t": [(0, "x")]}, "jsonl")).collect()] == [None]


@pytest.mark.parametrize("rows", [2, 10**6])
def test_rewinds_against_a_model(spark, rows):
    rng = random.Random(2)
    logs = {f"r{i}": [rng.randrange(8) for _ in range(rng.randrange(1, 12))] for i in range(150)} | {"example": [3, 5, 9, 12, 4, 9]}
    frame = spark.createDataFrame([(run, i, s, "x") for run, steps in logs.items() for i, s in enumerate(steps)], "run string, line long, step long, v string")
    want = {run: [(i, s) for i, s in enumerate(steps) if all(t > s for t in steps[i + 1 :])] for run, steps in logs.items()}
    got: dict = {}
    for r in rewind.resolve_rewinds(frame, rows).collect():
        got.setdefault(r["run"], []).append((r["line"], r["step"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert [s for _, s in want["example"]] == [3, 4, 9]
    again = {(r["run"], r["line"]) for r in rewind.repeated_steps(frame, rows).collect()}
    assert again == {(run, i) for run, steps in logs.items() for i in range(1, len(steps)) if steps[i] == steps[i - 1]}


def test_positions(spark):
    rng = random.Random(3)
    of = {m: sorted(rng.sample(range(10**6), 60)) for m in "abc"}
    frame = spark.createDataFrame([("r", m, s) for m, steps in of.items() for s in steps] + [(None, "z", 5)], "run string, metric string, step long")
    got = {(r["metric"], r["step"]): r["pos"] for r in points.with_pos(frame, rows=7).collect()}
    assert got == {(m, s): i for m, steps in of.items() for i, s in enumerate(steps)} | {("z", 5): 0}


def test_selectors(spark):
    of = series(spark, {"a": [(s * 10, v) for s, v in enumerate([1, 15, 4, 6, 40, math.nan])]})
    read = lambda **b: sorted(r["step"] for r in metric(of, "a", "f64", **b).collect())
    assert read(istart=2, istop=5) == [20, 30, 40] and read(start=5, stop=20) == [10, 20] and read(vstart=4, vstop=15) == [10, 20, 30]
    assert read(vstart=2) == [10, 20, 30, 40] and read(istart=9) == [] and read(start=9, stop=1) == [] and read(start=0.5) == [10, 20, 30, 40, 50]
    for bad in ({"start": 0, "istart": 0}, {"vstop": 1, "stop": 3}, {"istart": -1}):
        with pytest.raises(ValueError):
            metric(of, "a", "f64", **bad)
    with pytest.raises(TypeError):
        metric(of, "a", "jsonl", vstart=1)
    with pytest.raises(ValueError):
        metric(of, "a", "f16")
    single = series(spark, {"a": [(0, 0.699999988079071), (1, 0.7)]}).withColumn("dtype", F.lit("f32"))
    assert metric(single, "a", "f32", vstart=0.7).count() == 2
    whole = series(spark, {"a": [(0, 2**63), (1, 2**64 - 1), (2, 3)]}, "u64")
    assert sorted(r["value"] for r in metric(whole, "a", "u64", vstart=2**63, vstop=2**64 - 1).collect()) == [2**63, 2**64 - 1]
    assert [r["step"] for r in metric(whole, "a", "u64", vstop=3.5).collect()] == [2]
    picked = lambda i: [r["step"] for r in pick(metric(of, "a", "f64"), i).collect()]
    assert (picked(0), picked(2), picked(-1), picked(-6), picked(6), picked(-7)) == ([0], [20], [50], [0], [], [])
    assert Selector().family is None
    many = lambda i, **b: sorted(r["step"] for r in pick_many(metric(of, "a", "f64", **b), i).collect())
    places = [0, 10, 20, 30, 40, 50]
    for i in (slice(1, 4), slice(None, None, 2), slice(-2, None), slice(None, None, -2), slice(4, 1), slice(9, 12)):
        assert many(i) == sorted(places[i])
    assert many([0, -1, 0]) == [0, 50] and many([]) == [] and many(slice(1, None), vstart=4) == [20, 30, 40]
    with pytest.raises(IndexError):
        many([6])


def test_step_filters_reach_the_scan(spark, tmp_path):
    series(spark, {"a": [(i, i) for i in range(10)]}).write.partitionBy("metric").parquet(str(tmp_path / "p"))
    plan = metric(spark.read.parquet(str(tmp_path / "p")), "a", "f64", start=2, stop=4)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(step,2)" in plan and "PartitionFilters: [isnotnull(metric" in plan and "json" not in plan.split("ReadSchema")[1]


def test_merge_against_a_model(spark):
    rng = random.Random(4)
    cold = {f"m{i}": [(s, s) for s in sorted(rng.sample(range(20), rng.randrange(1, 6)))] for i in range(40) if i % 4}
    hot = {f"m{i}": [(s, -s) for s in sorted(rng.sample(range(25), rng.randrange(1, 6)))] for i in range(40) if i % 5}
    want = {}
    for m in set(cold) | set(hot):
        last = cold[m][-1][0] if m in cold else -1
        want[m] = cold.get(m, []) + [p for p in hot.get(m, []) if p[0] > last]
    c, h = series(spark, cold), series(spark, hot)
    got: dict = {}
    for r in merge.merge(c, h).collect():
        got.setdefault(r["metric"], []).append((r["pos"], r["step"], r["num"]))
    assert {m: [p[1:] for p in sorted(v)] for m, v in got.items()} == want
    assert all([p[0] for p in sorted(v)] == list(range(len(v))) for v in got.values())
    assert {r["metric"]: r["n"] for r in merge.merged_rows(c, h).collect()} == {m: len(v) for m, v in want.items()}


def test_compaction_batches(spark):
    log = spark.createDataFrame([(s,) for s in range(4)], "step long")
    assert sorted(r["step"] for r in merge.compaction_batch(log, 3, 4).collect()) == [0, 1, 2]
    assert merge.compaction_batch(log, 3, 2).collect() == []


def test_recovery_and_truncation(spark):
    cold, hot = series(spark, {"a": [(i, i) for i in range(6)]}), series(spark, {"a": [(i, -i) for i in range(4, 9)]})
    left, log = rewind.recover(cold, hot, 7)
    assert sorted(r["step"] for r in left.collect()) == [0, 1, 2, 3] and sorted(r["step"] for r in log.collect()) == [4, 5, 6]
    with pytest.raises(ValueError):
        rewind.truncate_to_step(cold, 0)
    assert rewind.truncate_to_step(cold, 0, allow_empty=True).count() == 0


def test_checks(spark):
    good = series(spark, {"a": [(0, 1), (2**32 - 1, 1)]})
    assert points.checked(good).count() == 2
    for bad in (series(spark, {"a": [(-1, 1)]}), series(spark, {"a": [(2**32, 1)]}), series(spark, {"step": [(0, 1)]})):
        with pytest.raises(Exception, match="out of range|not a metric name"):
            points.checked(bad).collect()
    twice = series(spark, {"a": [(0, 1), (0, 2), (1, 1)]})
    assert [tuple(r) for r in points.duplicates(twice).collect()] == [("r", "a", 0, 2)]


def test_order_of_steps(spark):
    good = series(spark, {"a": [(i, 1) for i in range(9)], "b": [(5, 1)]})
    assert points.increasing(good, rows=2).count() == 10 and points.out_of_order(good, rows=2).count() == 0
    bad = series(spark, {"a": [(0, 1), (4, 1), (4, 1), (6, 1), (2, 1)], "b": [(1, 1)]})
    for rows in (2, 10**6):
        assert sorted(tuple(r) for r in points.out_of_order(bad, rows).collect()) == [("r", "a", 2, 4, 4), ("r", "a", 4, 2, 6)]
    with pytest.raises(Exception, match="doesn't increase"):
        points.increasing(bad).collect()


def test_one_metric_with_most_rows_is_spread(spark):
    """With broadcasts off, no task of merging, placing, ordering or segmenting gets more than a few ranges of it."""
    seen = spark.range(0, 40_000).selectExpr("'r' as run", "if(id % 10 = 0, concat('m', id % 7), 'big') as metric", "id as pos", "id * 3 + id % 2 as step", "'f64' as dtype", "cast(id as double) as num", "cast(null as decimal(20,0)) as ival", "cast(null as string) as json")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "40"), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(k, v)
        cold = seen.where("step < 9000")
        fresh = merge.merge(cold, seen, 500).where("step >= 9000")
        for out in (points.with_pos(seen.drop("pos"), rows=500), fresh, segments.segment(seen, 500), points.out_of_order(seen.withColumn("step", -F.col("step")), 500)):
            sizes = [r["count"] for r in out.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()]
            assert sum(sizes) > 10_000 and max(sizes) < 0.25 * sum(sizes)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
