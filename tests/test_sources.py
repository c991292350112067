"""Runs on disk, whole and torn, their conversion, the store and the stream."""

import json
import os
from decimal import Decimal

import numpy as np
import pytest

from runweave.sources import convert, rundir
from runweave.sources.sink import export_run, replace_text
from runweave.store import RunStore
from runweave.streaming import ingest

NAME = rundir.NAME


def make(root, manifest, files=(), hot=None, config=None):
    folder = root / "run" / NAME
    folder.mkdir(parents=True)
    (folder / f"{NAME}.json").write_text(json.dumps(manifest))
    for name, data in dict(files).items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    if hot is not None:
        (folder / rundir.HOT).write_text(hot)
    if config is not None:
        (folder / "config.json").write_text(json.dumps(config))
    return root / "run"


def f32(*v):
    return np.array(v, dtype="<f4").tobytes()


def u32(*v):
    return np.array(v, dtype="<u4").tobytes()


def read(path, metric):
    steps, values, _ = rundir.RunFiles(path).points(metric)
    return list(map(int, steps)), [v if isinstance(v, str) else float(v) for v in values]


def test_open_tail_and_legacy_segments(tmp_path):
    run = make(tmp_path, {"loss": {"indices": [{"start": 7, "step": 5}], "dtype": "f32"}, "old": {"indices": {"start": 1, "stop": 4, "step": 1}, "dtype": "f32"}}, {"loss.f32": f32(8, 6, 4), "old.f32": f32(1, 2, 3)})
    assert read(run, "loss") == ([7, 12, 17], [8, 6, 4]) and read(run, "old")[0] == [1, 2, 3]
    assert rundir.RunFiles(run).approx_max_rows() == 3


def test_torn_files(tmp_path):
    files = {"a.indices": u32(0, 1) + b"\x01\x02", "a.f32": f32(5, 6) + b"\x00", "n.indices": u32(0, 1, 2), "n.jsonl": b'"a"\n"b"\n"c', "s.indices": u32(0, 1, 2, 3, 4), "s.f32": f32(1, 2, 3)}
    run = make(tmp_path, {m: {"indices": "indices", "dtype": d} for m, d in (("a", "f32"), ("n", "jsonl"), ("s", "f32"))}, files, hot='{"step": 7, "a": 1.5}\n{"step": 8, "a": 2')
    assert read(run, "a") == ([0, 1, 7], [5, 6, 1.5]) and read(run, "n") == ([0, 1], ['"a"', '"b"']) and read(run, "s")[0] == [0, 1, 2]
    (run / NAME / "n.jsonl").write_bytes(b'"a"\nbad\n"c"\n')
    with pytest.raises(ValueError, match="line 2"):
        read(run, "n")


def test_missing_files_need_a_log(tmp_path):
    manifest = {"a": {"indices": "indices", "dtype": "f32"}}
    with pytest.raises(FileNotFoundError):
        read(make(tmp_path / "x", manifest, {"a.indices": u32(0)}), "a")
    run = make(tmp_path / "y", manifest, {"a.indices": u32(0)}, hot='{"step": 3, "a": 1, "b": null}\n')
    assert read(run, "a") == ([3], [1.0]) and read(run, "b") == ([3], ["null"])
    files = rundir.RunFiles(run)
    assert files.metrics() == ["a", "b"] and files.rows("a") == 1
    with pytest.raises(KeyError):
        files.rows("c")


def test_hot_and_cold(tmp_path):
    files = {"loss.indices": u32(0, 1), "loss.f32": f32(1, 2)}
    run = make(tmp_path, {"loss": {"indices": "indices", "dtype": "f32"}}, files, hot='{"step": 1, "loss": 9}\n{"step": 2, "loss": 3, "acc": 7}\n', config={"lr": 1})
    assert read(run, "loss") == ([0, 1, 2], [1, 2, 3]) and read(run, "acc") == ([2], ["7"])
    files = rundir.RunFiles(run)
    assert (files.approx_max_rows(), files.approx_max_rows(faster=False), files.config()) == (2, 3, {"lr": 1})


def test_bad_manifests(tmp_path):
    with pytest.raises(ValueError, match="unknown dtype"):
        read(make(tmp_path / "a", {"m": {"indices": "indices", "dtype": "f16"}}, {"m.indices": u32(0), "m.f16": b""}), "m")
    with pytest.raises(ValueError, match="leaves the run"):
        rundir.RunFiles(make(tmp_path / "b", {"../m": {"indices": "indices", "dtype": "f32"}}))
    with pytest.raises(ValueError, match="closed segments"):
        read(make(tmp_path / "c", {"m": {"indices": [{"start": 0, "stop": 5, "step": 1}, {"start": 9, "step": 1}], "dtype": "f32"}}, {"m.f32": f32(1)}), "m")


def test_resolution(tmp_path, spark):
    run = make(tmp_path, {"a": {"indices": "indices", "dtype": "f32"}}, {"a.indices": u32(0, 5), "a.f32": f32(1, 2)})
    assert rundir.is_run(run) and rundir.is_run_dir(run) and rundir.is_run_dir(run / NAME) and rundir.resolve_run_dir(run) == (run / NAME).resolve()
    assert not rundir.is_run(tmp_path) and rundir.resolve(tmp_path / "none") is None
    rundir.register(spark)
    points = spark.read.format("metriclog").load(str(run))
    export_run(points, str(tmp_path / "z" / f"metrics.{NAME}"), config={"k": 1})
    packed = tmp_path / "z"
    assert rundir.is_run(packed) and not rundir.is_run_dir(packed) and rundir.RunFiles(packed).run == "z" and rundir.RunFiles(packed).config() == {"k": 1}
    (packed / f"metrics.{NAME}").write_bytes(b"no zip")
    assert not rundir.is_run(packed)
    with pytest.raises(FileNotFoundError):
        rundir.RunFiles(packed)


def test_source_reads_and_filters(tmp_path, spark):
    make(tmp_path / "many", {"a": {"indices": [{"start": 0, "stop": 100, "step": 1}], "dtype": "u64"}, "d/b": {"indices": "indices", "dtype": "jsonl"}}, {"a.u64": np.arange(2**64 - 100, 2**64, dtype="<u8").tobytes(), "d/b.indices": u32(4), "d/b.jsonl": '{"é": 1}\n'.encode()})
    rundir.register(spark)
    points = spark.read.format("metriclog").load(str(tmp_path / "many"))
    got = points.where("metric = 'a' and step >= 10 and step < 13").collect()
    assert sorted((r["run"], r["pos"], r["step"], int(r["ival"])) for r in got) == [("run", i, i, 2**64 - 100 + i) for i in (10, 11, 12)]
    assert [r["json"] for r in points.where("metric = 'd/b'").collect()] == ['{"é": 1}'] and points.count() == 101
    assert spark.read.format("metriclog").option("metrics", '["d/b"]').load(str(tmp_path / "many")).count() == 1
    assert spark.read.format("metriclog").option("start", 4).option("stop", 6).load(str(tmp_path / "many")).count() == 4
    runs, metrics = rundir.catalog([str(tmp_path / "many" / "run")])
    assert runs[0]["run"] == "run" and [m["metric"] for m in metrics] == ["a", "d/b"]


@pytest.mark.parametrize("archive", [False, True])
def test_ranges_read_only_what_they_need(tmp_path, spark, monkeypatch, archive):
    n = 200_000
    run = make(tmp_path, {"up": {"indices": "indices", "dtype": "f32", "monotonic": "inc"}, "down": {"indices": [{"start": 0, "stop": 3 * n, "step": 3}], "dtype": "i64", "monotonic": "dec"}, "mixed": {"indices": "indices", "dtype": "f64"}}, {"up.indices": (3 * np.arange(n)).astype("<u4").tobytes(), "up.f32": np.arange(n, dtype="<f4").tobytes(), "down.i64": (-np.arange(n)).astype("<i8").tobytes(), "mixed.indices": u32(0, 5, 9), "mixed.f64": np.array([4.0, np.nan, 7.0]).tobytes()}, config={})
    if archive:
        from runweave.sources.sink import pack

        (tmp_path / "z").mkdir()
        pack(run / NAME, tmp_path / "z" / f"metrics.{NAME}")
        run = tmp_path / "z"
    rundir.register(spark)

    def got(metric, **options):
        reader = spark.read.format("metriclog").option("metrics", json.dumps([metric]))
        for k, v in options.items():
            reader = reader.option(k, v)
        return sorted(r["pos"] for r in reader.load(str(run)).collect())

    for metric in ("up", "down"):
        assert got(metric, start=10, stop=30) == list(range(4, 11)) and got(metric, start=9.5, stop=11.5) == [] and got(metric, start=3 * n - 4) == [n - 1]
        assert got(metric, istart=5, istop=8) == [5, 6, 7] and got(metric, istart=n) == [] and got(metric, start=9, stop=3) == []
    assert got("up", vstart=6.5, vstop=9) == [7, 8, 9] and got("down", vstart=-9, vstop=-6.5) == [7, 8, 9] and got("down", vstart=-2) == [0, 1, 2] and got("down", vstop=-n + 2) == [n - 2, n - 1]
    assert got("mixed", vstart=4) == [0, 2] and got("mixed", vstop=5) == [0] and got("mixed") == [0, 1, 2]
    with pytest.raises(Exception, match="no run has"):
        got("none")
    with pytest.raises(Exception, match="can't be mixed"):
        got("up", start=1, istop=2)
    looked = []
    whole = rundir.RunFiles.read
    monkeypatch.setattr(rundir.RunFiles, "read", lambda self, file: looked.append(file) or whole(self, file))
    files = rundir.RunFiles(run)
    steps, values, dtype = files.points("up")
    assert files.places("up", steps, values, dtype, rundir.Selector(vstart=5, vstop=6)) == (5, 7, True)
    assert isinstance(values, np.memmap) and isinstance(steps, np.memmap) and looked == [f"{NAME}.json"]  # no file of numbers as a whole


def test_export_round_trip(tmp_path, spark):
    rows = [("r", "x", i, s, "i64", None, Decimal(v), None) for i, (s, v) in enumerate([(3, -1), (700, 5), (1600, 200)])] + [("r", "y", i, i, "f32", float(i), None, None) for i in range(50)] + [("r", "t", 0, 7, "jsonl", None, None, '"z"')]
    frame = spark.createDataFrame(rows, "run string, metric string, pos long, step long, dtype string, num double, ival decimal(20,0), json string")
    export_run(frame, str(tmp_path / "out"), archive=False)
    files = rundir.RunFiles(tmp_path / "out")
    assert files.manifest["x"] == {"indices": [{"start": 3, "stop": 1397, "step": 697}, {"start": 1600, "stop": 1601, "step": 1}], "dtype": "i16", "monotonic": "inc"}
    assert files.manifest["y"]["indices"] == [{"start": 0, "stop": 50, "step": 1}] and files.manifest["t"] == {"indices": "indices", "dtype": "jsonl"} and files.run_rows == 50
    assert read(tmp_path / "out", "x") == ([3, 700, 1600], [-1, 5, 200]) and read(tmp_path / "out", "t") == ([7], ['"z"'])
    export_run(frame.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        replace_text(tmp_path / "x", "")


def log(tmp_path, name, lines, config=None):
    folder = tmp_path / name
    folder.mkdir(parents=True)
    (folder / convert.LOG).write_text("".join(json.dumps(x) + "\n" for x in lines))
    if config:
        (folder / "config.json").write_text(json.dumps(config))
    return folder


def test_conversion(tmp_path, spark):
    log(tmp_path / "in", "a", [{"step": 40, "loss": 1.5}, {"step": 90, "loss": 2, "note": "x", "pnorm": 3}], {"lr": 1})
    log(tmp_path / "in", "b", [{"n": 1, "flag": True}, {}, {"n": 300, "mixed": 1.0}, {"mixed": None, "huge": 2**63}])
    done = convert.convert(spark, [str(tmp_path / "in")], str(tmp_path / "out"), skip=("DEFAULT",), workers=2)
    assert [(os.path.basename(p), n, c) for p, n, c in done] == [(f"a.{NAME}", 2, 2), (f"b.{NAME}", 4, 2)]
    a, b = (rundir.RunFiles(p) for p, *_ in done)
    assert a.manifest["loss"]["dtype"] == "f64" and read(done[0][0], "loss") == ([40, 90], [1.5, 2.0]) and "pnorm" not in a.manifest and a.config() == {"lr": 1}
    assert read(done[0][0], "note") == ([90], ['"x"'])
    assert {m: s["dtype"] for m, s in b.manifest.items()} == {"n": "u16", "flag": "jsonl", "mixed": "f32", "huge": "u64"} and read(done[1][0], "n") == ([0, 2], [1, 300])
    assert np.isnan(read(done[1][0], "mixed")[1][1]) and b.config() == {}
    convert.convert(spark, [str(tmp_path / "in")])
    assert rundir.is_run(tmp_path / "in" / "a") and convert.discover_runs([str(tmp_path)], deep=True)[0].name == "a" and convert.discover_runs([str(tmp_path)]) == []


def test_rewound_logs(tmp_path, spark):
    folder = log(tmp_path, "r", [{"step": s, "v": v} for s, v in ((10, 1), (20, 2), (35, 3), (40, 4), (35, 30), (36, 31))])
    points = convert.points_of_logs(convert.read_logs(spark, [str(folder / convert.LOG)], allow_rewinds=True), allow_rewinds=True)
    assert sorted((r["step"], int(r["ival"])) for r in points.collect()) == [(10, 1), (20, 2), (35, 30), (36, 31)]


@pytest.mark.parametrize("lines, rewinds, match", [
    (['{"step": 1}', '{"step": 1}'], True, "increase"), (['{"step": 2}', '{"step": 1}'], False, "allow rewinds"), (['{"a": 1}', '{"step": 1}'], True, "only some"), (['{"step": 1}', '{"a": 1}'], True, "only some"),
    (['{"step": 1.5}'], False, "integer"), (['{"step": true}'], False, "integer"), (['{"step": -1}'], False, "range"), (['{"step": 4294967296}'], False, "range"), (['{"a": 1}', ""], False, "not JSON"), (["[1]"], False, "object"), (['{"a": '], False, "not JSON"),
])
def test_bad_logs(lines, rewinds, match):
    with pytest.raises((ValueError, TypeError), match=match):
        convert.parse_log("\n".join(lines) + "\n", "log", rewinds)


def test_good_logs():
    assert [r[1] for r in convert.parse_log('{"step": null, "a": 1}\n{"a": NaN}', "x")] == [0, 1]
    with pytest.raises(FileNotFoundError):
        convert.discover_runs(["/no/such/folder"])


def test_store(tmp_path, spark):
    store = RunStore(spark, str(tmp_path / "store"))
    w = store.writer("a/b", file_rows=2, config={"lr": 1})
    for i in range(5):
        w.write(loss=float(i), note="x" if i % 2 else None)
        w.write({"n": i})
        with pytest.raises(RuntimeError):
            w.write(loss=1)
        w.end_step()
        assert i not in (0, 3) or store.rows("a/b", "loss") == i + 1  # each step is there when it ends
    w.end_step()  # a step without values
    w.write(loss=9.0, flush=True)
    w.write(late=1)
    with pytest.raises(ValueError):
        w.write({"z": 1}, z=2)
    with pytest.raises(ValueError):
        w.write(step=1)
    assert sorted(r["step"] for r in store.metric("a/b", "loss").collect()) == [0, 1, 2, 3, 4, 6]
    assert store.compact("a/b", hotsize=3, current_step=6) == 3 and store.compact("a/b", hotsize=3, current_step=5) == 0
    assert store.metrics("a/b") == ["loss", "n", "note"] and store.approx_max_rows("a/b") == 3 and store.approx_max_rows("a/b", faster=False) == 6
    assert [(r["pos"], r["value"]) for r in store.metric("a/b", "loss", idx=-1).collect()] == [(5, 9.0)]
    with pytest.raises(IndexError):
        store.metric("a/b", "loss", idx=6)
    with pytest.raises(KeyError):
        store.metric("a/b", "none")
    w.finish()
    with pytest.raises(RuntimeError):
        w.write(loss=1)
    entry = store.described("a/b")
    assert entry["run_rows"] == 6 and entry["metrics"]["n"]["dtype"] == "u8" and entry["metrics"]["loss"]["monotonic"] == "inc" and store.config("a/b") == {"lr": 1}
    assert sorted((r["step"], r["value"]) for r in store.metric("a/b", "note").collect()) == [(0, "null"), (1, '"x"'), (2, "null"), (3, '"x"'), (4, "null")]
    with pytest.raises(RuntimeError):
        store.writer("a/b", step=3)
    with pytest.raises(ValueError):
        store.writer("a/b", resume_finished=True)
    again = store.writer("a/b", step=3, resume_finished=True)
    entry = store.described("a/b")
    assert "run_rows" not in entry and entry["metrics"]["loss"] == {"dtype": "f32"} and store.approx_max_rows("a/b") == 3
    again.write(loss=7.0, n=300)  # more than the u8 of the finished run holds
    again.end_step()
    assert sorted((r["step"], r["value"]) for r in store.metric("a/b", "loss").collect()) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 7.0)]
    (tmp_path / "c.json").write_text('{"lr": 2}')
    again.set_config(str(tmp_path / "c.json"))
    (tmp_path / "c.json").write_text('{"lr": 3}')
    assert store.config("a/b") == {"lr": 3}
    again.set_config(str(tmp_path / "none.json"))
    again.set_config(None)
    assert store.config("a/b") == {"lr": 3} and store.when_exported("a/b").endswith("Z")
    store.export("a/b", str(tmp_path / f"x.{NAME}"))
    assert read(tmp_path / f"x.{NAME}", "loss")[0] == [0, 1, 2, 3] and store.runs() == ["a/b"]
    again.finish()
    assert store.described("a/b")["metrics"]["n"]["dtype"] == "u16" and sorted(r["value"] for r in store.metric("a/b", "n").collect()) == [0, 1, 2, 300]


def steps(store, run="r"):
    return sorted(r["step"] for r in store.metric(run, "m").collect())


def test_a_crash_anywhere_loses_nothing(tmp_path, spark, monkeypatch):
    """A step that is logged while compaction runs, and a process that ends at each step of what takes data away."""
    store = RunStore(spark, str(tmp_path / "s"))
    w = store.writer("r", file_rows=2)
    for i in range(5):
        w.write(m=float(i))
        w.end_step()
    put = store._put_log

    def meanwhile(*args):
        w.write(m=5.0)
        w.end_step()
        put(*args)

    store._put_log = meanwhile
    assert store.compact("r", 3, 5) == 3 and steps(store) == list(range(6))
    store._put_log = put
    for i in range(6, 9):
        w.write(m=float(i))
        w.end_step()

    class Crash(Exception):
        pass

    def crash(*args, **kwargs):
        raise Crash

    for place, call in (("_put_log", lambda: store.compact("r", 1, 9)), ("_put_log", lambda: store.truncate("r", 9)), ("describe", lambda: store.truncate("r", 9)), ("describe", lambda: store.finish("r"))):
        with monkeypatch.context() as m, pytest.raises(Crash):
            m.setattr(store, place, crash)
            call()
        assert steps(store) == list(range(9)), place
    store.finish("r")
    assert steps(store) == list(range(9)) and len(list((tmp_path / "s" / "points" / "run=r").glob("*"))) == 1


def test_compaction_by_itself_and_torn_lines(tmp_path, spark):
    store = RunStore(spark, str(tmp_path / "s"))
    w = store.writer("r", file_rows=3, hotsize=4)
    for i in range(11):
        w.write(m=float(i))
        w.end_step()
    w._compaction.result()
    assert store.cold("r").count() == 4 and steps(store) == list(range(11)) and store.approx_max_rows("r") == 4
    file = sorted(store._log("r").glob("*.json"))[-1]
    w._close_file()
    with file.open("a") as f:
        f.write('{"seq": 99, "step": 11, "val')
    assert steps(store) == list(range(11))
    with file.open("a") as f:
        f.write('\n{"seq": 100, "step": 12, "values": []}\n')
    with pytest.raises(Exception, match="bad line"):
        steps(store)


def test_stream_is_idempotent_and_reports_late_points(tmp_path, spark):
    landing, table, late, state = (str(tmp_path / n) for n in ("in", "points", "late", "state"))
    os.mkdir(landing)

    def land(name, rows):
        with open(f"{landing}/{name}.json", "w") as f:
            for run, step, value in rows:
                f.write(json.dumps({"run": run, "step": step, "values": [{"metric": "m", "dtype": "f64", "num": value}]}) + "\n")

    def take():
        query = ingest.start_ingest(ingest.read_rows(spark, landing), table, state, late)
        query.awaitTermination()
        return sorted((r["run"], r["pos"], r["step"], r["num"]) for r in ingest.points_before(spark, table).collect())

    land("1", [("a", 0, 1.0), ("a", 1, 2.0), ("b", 5, 3.0)])
    first = take()
    assert first == [("a", 0, 0, 1.0), ("a", 1, 1, 2.0), ("b", 0, 5, 3.0)] and take() == first
    land("2", [("a", 1, 9.0), ("a", 2, 4.0), ("a", 2, 4.0), ("b", 4, 9.0)])
    assert take() == [*first[:2], ("a", 2, 2, 4.0), first[2]]
    assert sorted((r["run"], r["step"]) for r in spark.read.parquet(late).collect()) == [("a", 1), ("b", 4)]
    land("3", [("a", 3, 7.0), ("c", 1, 1.0), ("a", 3, 8.0), ("c", 1, 2.0)])  # the last of a step counts
    assert take()[3:] == [("a", 3, 3, 8.0), ("b", 0, 5, 3.0), ("c", 0, 1, 2.0)]
