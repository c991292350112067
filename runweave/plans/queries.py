"""Registered queries of the metric-log engine, each with its SQL.

The tables serve as metric logs: `events` as a run with a metric for each kind
of event (steps are event ids, irregular within a metric) or with wide rows,
`orders` as a run of several metrics with contiguous steps, `conversations` as
a run for each conversation with a metric for each role.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions.types import infer_column, tightest_sql
from runweave.operators import merge as M
from runweave.operators import monotonic, rewind, segments
from runweave.operators import points as P
from runweave.operators.select import metric, pick

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, dtype: str = "f64") -> DataFrame:
    """Points without pos: a metric for each kind of event."""
    t = _table(spark, sf_dir, "events")
    return P.from_long(t, F.lit("events"), F.col("event_type"), F.col("event_id"), F.col("value"), dtype)


def placed(spark: SparkSession, sf_dir: str, dtype: str = "f64", name: str | None = None) -> DataFrame:
    """Points with pos; of one metric, which the scan is filtered by, or of all."""
    found = events(spark, sf_dir, dtype)
    return P.with_pos(found if name is None else found.where(F.col("metric") == name)).select(*P.COLUMNS)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without pos of `events` with the metrics value, walltime and props."""
    t = _table(spark, sf_dir, "events")
    return P.from_wide(t, F.lit("events"), F.col("event_id"), {"value": (F.col("value"), "f64"), "walltime": (F.unix_micros(F.col("ts").cast("timestamp")), "i64"), "props": (F.col("props"), "jsonl")})


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "orders")
    return P.from_wide(t, F.lit("orders"), F.col("o_orderkey"), {"custkey": (F.col("o_custkey"), "i64"), "price": (F.col("o_totalprice"), "f64"), "status": (F.col("o_orderstatus"), "jsonl")})


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations")
    return P.from_long(t, F.col("conv_id").cast("string"), F.col("role"), F.col("turn"), F.col("text"), "jsonl")


_EV = "select event_type as metric, event_id as step, value, row_number() over (partition by event_type order by event_id) - 1 as pos from events"
_PURCHASE = f"with ev as ({_EV}), m as (select pos, step, value from ev where metric = 'purchase')"


@_query(f"{_PURCHASE} select pos, step, value from m")
def metric_full(spark, sf_dir):
    return metric(placed(spark, sf_dir, name="purchase"), "purchase", "f64")


@_query("select event_id as step from events where event_type = 'click'")
def metric_steps(spark, sf_dir):
    return metric(events(spark, sf_dir).withColumn("pos", F.lit(0)), "click", "f64").select("step")


@_query("select value from events where event_type = 'click'")
def metric_values(spark, sf_dir):
    return metric(events(spark, sf_dir).withColumn("pos", F.lit(0)), "click", "f64").select("value")


@_query(f"{_PURCHASE} select pos, step, value from m where step between 100 and 5000")
def step_range(spark, sf_dir):
    return metric(placed(spark, sf_dir, name="purchase"), "purchase", "f64", start=100, stop=5000)


@_query(f"{_PURCHASE} select pos, step, value from m where step >= 700.5")
def step_range_open(spark, sf_dir):
    return metric(placed(spark, sf_dir, name="purchase"), "purchase", "f64", start=700.5)


@_query(f"{_PURCHASE} select pos, step, value from m where step >= 20 and step <= 10")
def step_range_empty(spark, sf_dir):
    return metric(placed(spark, sf_dir, name="purchase"), "purchase", "f64", start=20, stop=10)


@_query(f"{_PURCHASE} select pos, step, value from m where pos >= 20 and pos < 90")
def position_range(spark, sf_dir):
    return metric(placed(spark, sf_dir, name="purchase"), "purchase", "f64", istart=20, istop=90)


@_query(f"{_PURCHASE} select pos, step, value from m where value >= 10.0 and value <= 60.0")
def value_range(spark, sf_dir):
    return metric(placed(spark, sf_dir, name="purchase"), "purchase", "f64", vstart=10.0, vstop=60.0)


@_query(f"{_PURCHASE} select pos, step, cast(value as float) as value from m where cast(value as float) >= cast(9.7 as float) and cast(value as float) <= cast(50.3 as float)")
def value_range_f32(spark, sf_dir):
    return metric(placed(spark, sf_dir, "f32", "purchase"), "purchase", "f32", vstart=9.7, vstop=50.3)


@_query("select o_orderkey as pos, o_orderkey as step, o_custkey as value from orders where o_custkey >= 10.5 and o_custkey <= 90")
def value_range_integer(spark, sf_dir):
    return metric(P.with_pos(order_points(spark, sf_dir).where("metric = 'custkey'")), "custkey", "i64", vstart=10.5, vstop=90)


@_query(f"{_PURCHASE} select pos, step, value from m order by pos limit 1 offset 2")
def pick_third(spark, sf_dir):
    return pick(metric(placed(spark, sf_dir, name="purchase"), "purchase", "f64"), 2)


@_query(f"{_PURCHASE} select pos, step, value from m where step <= 800 order by pos desc limit 1")
def pick_last(spark, sf_dir):
    return pick(metric(placed(spark, sf_dir, name="purchase"), "purchase", "f64", stop=800), -1)


@_query("select distinct 'events' as run, event_type as metric from events union select 'events', m from (values ('value'), ('walltime'), ('props')) t(m)")
def list_metrics(spark, sf_dir):
    return P.metric_names(events(spark, sf_dir), wide(spark, sf_dir))


@_query("select 'events' as run, event_type as metric, count(*) as n from events group by event_type")
def rows_per_metric(spark, sf_dir):
    return P.rows_per_metric(events(spark, sf_dir))


@_query("select run, max(n) as run_rows from (select cast(conv_id as varchar) as run, role, count(*) as n from conversations group by all) group by run")
def run_rows(spark, sf_dir):
    return P.run_rows(talks(spark, sf_dir))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Compacted points up to another step for each metric, and a log that overlaps with them."""
    all_ = placed(spark, sf_dir).where("metric <> 'signup'")
    cold = all_.where(F.col("step") <= 500 + 10 * F.length("metric"))
    hot = placed(spark, sf_dir).where("step > 400").withColumn("pos", F.col("step"))
    return cold, hot


_HALVES = f"""with ev as ({_EV}), cold as (select * from ev where metric <> 'signup' and step <= 500 + 10 * length(metric)), hot as (select * from ev where step > 400),
 last as (select metric, max(step) as last_step, count(*) as n from cold group by metric),
 fresh as (select h.metric, h.step, h.value, coalesce(l.n, 0) + row_number() over (partition by h.metric order by h.step) - 1 as pos from hot h left join last l on h.metric = l.metric where l.last_step is null or h.step > l.last_step)"""


@_query(f"{_HALVES} select metric, pos, step, value from cold union all select metric, pos, step, value from fresh")
def hot_cold_merge(spark, sf_dir):
    return M.merge(*_halves(spark, sf_dir)).select("metric", "pos", "step", F.col("num").alias("value"))


@_query(f"{_HALVES} select metric, count(*) as n from (select metric from cold union all select metric from fresh) group by metric")
def merge_rows(spark, sf_dir):
    return M.merged_rows(*_halves(spark, sf_dir)).select("metric", "n")


@_query(f"{_HALVES} select pos, step, value from fresh where metric = 'signup'")
def hot_only_metric(spark, sf_dir):
    return metric(M.merge(*_halves(spark, sf_dir)), "signup", "f64")


@_query(f"{_HALVES} select h.metric, h.step, h.value from hot h join last l on h.metric = l.metric where h.step <= l.last_step")
def late_points(spark, sf_dir):
    return M.late(*_halves(spark, sf_dir)).select("metric", "step", F.col("num").alias("value"))


@_query("select event_type as metric, event_id as step, value from events where event_id < 600")
def truncate_to_step(spark, sf_dir):
    return rewind.truncate_to_step(events(spark, sf_dir), 600).select("metric", "step", F.col("num").alias("value"))


@_query(f"{_HALVES} select 'cold' as side, metric, step from cold where step < 401 union all select 'hot', metric, step from hot where step < 700")
def recover_run(spark, sf_dir):
    cold, hot = rewind.recover(*_halves(spark, sf_dir), step=700)
    return cold.select(F.lit("cold").alias("side"), "metric", "step").unionByName(hot.select(F.lit("hot").alias("side"), "metric", "step"))


_REPLAY = """with rw as (select event_id as line, event_id as step, value, user_id from events union all
 select (select max(event_id) from events) + 1 + event_id as line, event_id + (select max(event_id) from events) // 2 as step, -value, user_id from events where event_id < 500)"""


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a log that is taken back to its middle and goes on from there for 500 rows."""
    t = _table(spark, sf_dir, "events")
    last = t.agg(F.max("event_id").alias("last"))  # one row
    again = t.where("event_id < 500").crossJoin(F.broadcast(last)).select(F.lit("events").alias("run"), (F.col("last") + 1 + F.col("event_id")).alias("line"), (F.col("event_id") + F.floor(F.col("last") / 2)).alias("step"), (-F.col("value")).alias("value"))
    return t.select(F.lit("events").alias("run"), F.col("event_id").alias("line"), F.col("event_id").alias("step"), "value").unionByName(again)


@_query(f"{_REPLAY} select line, step, value from (select *, min(step) over (order by line rows between 1 following and unbounded following) as later from rw) where later is null or later > step")
def rewind_resolve(spark, sf_dir):
    return rewind.resolve_rewinds(_replayed(spark, sf_dir)).select("line", "step", "value")


@_query("select 'events' as run, event_type as metric, event_id as step from events where not regexp_full_match(event_type, 'p.*|.*out')")
def skip_columns(spark, sf_dir):
    return M.without(events(spark, sf_dir), ("p.*", ".*out")).select("run", "metric", "step")


_WIDE = """with w as (select event_id as pos, 'value' as metric, value as num from events union all select event_id, 'walltime', epoch_us(ts) from events union all
 select event_id, 'falling', -event_id from events union all select event_id, 'flat', 1 from events)"""


@_query(f"""{_WIDE} select metric, case when not bool_or(coalesce(num < prev, false)) then 'inc' when not bool_or(coalesce(num > prev, false)) then 'dec' end as monotonic
 from (select *, lag(num) over (partition by metric order by pos) as prev from w) group by metric""")
def monotonic_direction(spark, sf_dir):
    t = _table(spark, sf_dir, "events")
    more = {"value": (F.col("value"), "f64"), "walltime": (F.unix_micros(F.col("ts").cast("timestamp")), "i64"), "falling": (-F.col("event_id"), "i64"), "flat": (F.lit(1), "i64")}
    w = P.from_wide(t, F.lit("events"), F.col("event_id"), more).withColumn("pos", F.col("step"))
    return monotonic.direction(w, rows=20_000).select("metric", "monotonic")


_TIGHT = """select metric, case when low >= 0 then case when high <= 255 then 'u8' when high <= 65535 then 'u16' when high <= 4294967295 then 'u32' else 'u64' end
 else case when low >= -128 and high <= 127 then 'i8' when low >= -32768 and high <= 32767 then 'i16' when low >= -2147483648 and high <= 2147483647 then 'i32' else 'i64' end end as dtype"""


@_query(f"""{_TIGHT} from (select metric, min(v) as low, max(v) as high from (select 'size' as metric, p_size as v from part union all select 'key', p_partkey from part union all
 select 'minus', -p_size from part union all select 'wide', p_partkey * 100000 from part) group by metric)""")
def tighten_int_dtype(spark, sf_dir):
    t = _table(spark, sf_dir, "part")
    more = {"size": (F.col("p_size"), "i64"), "key": (F.col("p_partkey"), "i64"), "minus": (-F.col("p_size"), "i64"), "wide": (F.col("p_partkey") * 100_000, "i64")}
    w = P.from_wide(t, F.lit("part"), F.col("p_partkey"), more)
    return w.groupBy("metric").agg(F.min("ival").alias("low"), F.max("ival").alias("high")).select("metric", tightest_sql(F.col("low"), F.col("high")).alias("dtype"))


@_query("""with v as (select 'ints' as metric, 'int' as kind, cast(l_linenumber as decimal(38,0)) as v, 'i64' as tag from lineitem union all select 'floats', 'float', null, 'f32' from lineitem union all
 select 'both', case when l_linenumber % 2 = 0 then 'int' else 'float' end, case when l_linenumber % 2 = 0 then cast(l_linenumber as decimal(38,0)) end, 'f32' from lineitem union all
 select 'flags', 'bool', null, 'jsonl' from lineitem union all select 'words', 'other', null, 'jsonl' from lineitem)
 select metric, case when bool_or(kind = 'other') or not bool_or(kind in ('int', 'float')) then max(tag) when bool_or(kind = 'float') and bool_or(kind = 'int') then 'f64'
 when bool_or(kind = 'float') then 'f32' when max(v) <= 255 then 'u8' end as dtype from v group by metric""")
def infer_dtype(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    whole = F.col("l_linenumber").cast("decimal(38,0)")
    row = lambda m, k, v, tag: F.struct(F.lit(m).alias("metric"), k.alias("kind"), v.cast("decimal(38,0)").alias("v"), F.lit(tag).alias("tag"))
    none = F.lit(None)
    rows = F.array(row("ints", F.lit("int"), whole, "i64"), row("floats", F.lit("float"), none, "f32"), row("both", F.when(even, "int").otherwise("float"), F.when(even, whole), "f32"), row("flags", F.lit("bool"), none, "jsonl"), row("words", F.lit("other"), none, "jsonl"))
    seen = t.select(F.explode(rows).alias("r")).select("r.*").groupBy("metric").agg(F.collect_set("kind").alias("kinds"), F.min("v").alias("low"), F.max("v").alias("high"), F.max("tag").alias("tag"))
    return seen.select("metric", infer_column(F.col("kinds"), F.col("low"), F.col("high"), F.col("tag")).alias("dtype"))


_SEGMENTS = """p as (select g, step, row_number() over (partition by g order by step) rn, count(*) over (partition by g) n, lead(step) over (partition by g order by step) - step diff from t),
d as (select *, case when diff = lag(diff) over (partition by g order by rn) then 0 else 1 end brk from p where diff is not null),
r as (select g, rid, min(rn) f, count(*) l, min(diff) diff, max(n) n from (select *, sum(brk) over (partition by g order by rn) rid from d) x group by g, rid),
b0 as (select *, sum(case when l >= 2 then 1 else 0 end) over (partition by g order by rid rows between unbounded preceding and 1 preceding) nb from r),
b1 as (select *, coalesce(nb, 0) nb2 from b0),
b2 as (select *, (case when nb2 > 0 then 1 else 0 end + row_number() over (partition by g, nb2 order by rid) - 1) % 2 as b from b1),
seg as (select b2.g as metric, p.step as start, p.step + (l - b + 1) * b2.diff as stop, b2.diff as stride from b2 join p on p.g = b2.g and p.rn = b2.f + b2.b where l - b >= 1
 union all select p.g, p.step, p.step + 1, 1 from p join b2 on p.g = b2.g and b2.b = 1 and b2.l = 1 and b2.f = p.n - 1 and p.rn = p.n
 union all select g, step, step + 1, 1 from p where n = 1)"""
_EVENT_SEGMENTS = f"with t as (select event_type as g, event_id as step from events union all select 'all', event_id from events where event_id % 7 <> 3), {_SEGMENTS}"


def _event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = events(spark, sf_dir).select("run", "metric", "step").unionByName(events(spark, sf_dir).where("step % 7 <> 3").select("run", F.lit("all").alias("metric"), "step"))
    return segments.segment(both, rows=20_000)


@_query(f"{_EVENT_SEGMENTS} select metric, start, stop, stride from seg")
def segment_steps(spark, sf_dir):
    return _event_segments(spark, sf_dir).select("metric", "start", "stop", "stride")


@_query("select event_type as metric, event_id as step from events union all select 'all', event_id from events where event_id % 7 <> 3")
def segments_expand(spark, sf_dir):
    return segments.expand(_event_segments(spark, sf_dir)).select("metric", "step")


@_query(f"{_EVENT_SEGMENTS} select metric, n_points, n_segments, case when n_points >= 2 and n_segments <= greatest(4, n_points // 10) then 'segments' else 'indices' end as mode from (select metric, cast(sum((stop - start + stride - 1) // stride) as bigint) as n_points, count(*) as n_segments from seg group by metric)")
def segments_threshold(spark, sf_dir):
    return segments.index_mode(_event_segments(spark, sf_dir)).select("metric", F.col("n_points").cast("bigint").alias("n_points"), "n_segments", "mode")


@_query("select event_type as metric, event_id as step from events where event_id < 555 union all select 'all', event_id from events where event_id % 7 <> 3 and event_id < 555")
def segments_truncate(spark, sf_dir):
    return segments.expand(segments.truncate(_event_segments(spark, sf_dir), 555)).select("metric", "step")


@_query(f"{_EVENT_SEGMENTS} select metric, cast(sum((stop - start + stride - 1) // stride) as bigint) as n, max(start + (stop - start - 1) // stride * stride) as last_step from seg group by metric")
def segments_count_and_last(spark, sf_dir):
    s = _event_segments(spark, sf_dir)
    last = F.col("start") + F.floor((F.col("stop") - F.col("start") - 1) / F.col("stride")) * F.col("stride")
    return s.groupBy("metric").agg(F.sum(segments.segment_count(F.col("start"), F.col("stop"), F.col("stride"))).alias("n"), F.max(last).alias("last_step"))


@_query("select 'custkey' as metric, o_orderkey as step, o_custkey as ival, cast(null as double) as num, cast(null as varchar) as json from orders union all select 'price', o_orderkey, null, o_totalprice, null from orders union all select 'status', o_orderkey, null, null, o_orderstatus from orders")
def wide_to_long(spark, sf_dir):
    return order_points(spark, sf_dir).select("metric", "step", F.col("ival").cast("bigint").alias("ival"), "num", "json")


@_query("select o_orderkey as step, o_custkey as custkey, o_totalprice as price, o_orderstatus as status from orders")
def long_to_wide(spark, sf_dir):
    return P.to_wide(order_points(spark, sf_dir), {"custkey": "i64", "price": "f64", "status": "jsonl"}).drop("run")


@_query("select 'lineitem' as run, cast(l_linenumber as varchar) as metric, l_orderkey as step, count(*) as times from lineitem group by l_linenumber, l_orderkey having count(*) > 1")
def duplicate_points(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem")
    return P.duplicates(P.from_long(t, F.lit("lineitem"), F.col("l_linenumber").cast("string"), F.col("l_orderkey"), F.col("l_quantity"), "f64"))


@_query("select event_id as step, user_id, value from (select * from events where event_id < 700 order by event_id limit 200)")
def compaction_batch(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), "user_id", "value")
    return M.compaction_batch(log, 200, 700)


@_query("select user_id as step, event_id as seq, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1")
def latest_hot_row(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.lit("events").alias("run"), F.col("user_id").alias("step"), F.col("event_id").alias("seq"), "value")
    return M.latest_rows(log).select("step", "seq", "value")


@_query("select cast(conv_id as varchar) as run, role as metric, turn as step, row_number() over (partition by conv_id, role order by turn) - 1 as pos, text as value from conversations")
def json_metric(spark, sf_dir):
    return P.with_pos(talks(spark, sf_dir)).select("run", "metric", "step", "pos", F.col("json").alias("value"))


@_query(f"""with ev as ({_EV}), v as (select * from ev where metric = 'view'), p as (select * from ev where metric = 'purchase')
 select p.step as step, p.value as value, (select max(v.step) from v where v.step <= p.step) as other_step from p""")
def align_as_of(spark, sf_dir):
    """An extension: for each point of one metric the last step of another at or before it."""
    from pyspark.sql import Window

    both = events(spark, sf_dir).where(F.col("metric").isin("view", "purchase"))
    ranged = P.step_ranges(both, ["run"], "step", 100_000)
    seen = F.when(F.col("metric") == "view", F.col("step"))
    ends = ranged.groupBy("__keys", "__range").agg(F.max(seen).alias("end"))
    before = ends.select("__keys", "__range", F.max("end").over(Window.partitionBy("__keys").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    here = F.max(seen).over(Window.partitionBy("__keys", "__range").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    joined = P.with_range(ranged, before).withColumn("here", here)
    return joined.where("metric = 'purchase'").select("step", F.col("num").alias("value"), F.coalesce("here", "before").alias("other_step"))
