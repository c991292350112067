"""A store of runs: live logs, compacted columns and a catalog, all as Spark tables.

    <root>/runs/<run>.json                     config, types, segments, counts, and the version that holds
    <root>/log/run=<run>/<version>/<n>.json    rows as they are logged, not compacted yet
    <root>/points/run=<run>/<version>/...      compacted points, Parquet

Training code logs through `RowWriter`, which needs no Spark but for compaction.
Readers see the log and the compacted points as one; compaction moves rows from
one to the other. What takes data away (truncation, finishing) writes a new
version and then replaces the catalog entry, at once; the old version goes after
that, so a crash at any point leaves one of both whole.
"""

from __future__ import annotations

import datetime
import json
import os
import shutil
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from pathlib import Path
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions.types import JSON, LAST_STEP, SIGNED, UNSIGNED, coerce, infer
from runweave.operators import merge, rewind
from runweave.operators.points import COLUMNS, SCHEMA, rows_per_metric
from runweave.operators.select import metric as select_metric
from runweave.operators.select import pick, pick_many
from runweave.sources.sink import describe, export_run, replace_text

LOG_SCHEMA = "seq bigint, step bigint, values array<struct<metric:string,dtype:string,num:double,ival:decimal(20,0),json:string>>"


class RowWriter:
    """Logs rows of one run, a step after the other; to be used from one thread.

    Each finished step is written to the log at once, as a line, and can be read
    from then on; `write(flush=True)` writes the unfinished one as it is, which
    a later line replaces. A log file takes `file_rows` lines. With `hotsize`,
    whenever the log has so many finished rows, as many are compacted in the
    background; what goes wrong there raises at the next call.
    """

    def __init__(self, store: RunStore, run: str, step: int, file_rows: int, hotsize: int | None = None):
        if step < 0 or file_rows <= 0 or (hotsize is not None and hotsize <= 0):
            raise ValueError("step can't be negative, file_rows and hotsize must be positive")
        self._store, self.run, self.step, self._file_rows, self._hotsize = store, run, step, file_rows, hotsize
        self._dtypes = {m: spec["dtype"] for m, spec in store.described(run).get("metrics", {}).items()}
        self._row: dict[str, dict] = {}
        self._file = None
        self._in_file = self._seq = self._waiting = 0
        self._pool = ThreadPoolExecutor(1) if hotsize else None
        self._compaction: Future | None = None
        self._open = True

    def write(self, metrics: dict[str, Any] | None = None, flush: bool = False, **more: Any) -> None:
        """Log values at the current step. All are checked before any is taken."""
        self._check()
        if metrics is not None and not isinstance(metrics, dict):
            raise TypeError("metrics must be a dict")
        if set(metrics or {}) & set(more):
            raise ValueError(f"given twice: {sorted(set(metrics or {}) & set(more))}")
        if not 0 <= self.step <= LAST_STEP:
            raise ValueError(f"step out of range: {self.step}")
        new, types = {}, {}
        for name, value in {**(metrics or {}), **more}.items():
            if name == "step" or not name:
                raise ValueError(f"not a metric name: {name!r}")
            if name in self._row:
                raise RuntimeError(f"{name} was already written at step {self.step}")
            types[name] = self._dtypes.get(name) or infer(value)
            stored = coerce(value, types[name])
            kind = "json" if types[name] == JSON else "num" if types[name][0] == "f" else "ival"
            new[name] = {"metric": name, "dtype": types[name], kind: stored}
        self._row |= new
        self._dtypes |= types
        if flush and self._row:
            self._append()

    def end_step(self) -> None:
        """Go on to the next step; a step without values leaves no row."""
        self._check()
        if self._row:
            self._append()
            self._waiting += 1
        self._row = {}
        self.step += 1
        if self._hotsize and self._waiting >= self._hotsize and self._compaction is None:
            self._close_file()
            self._waiting -= self._hotsize
            self._compaction = self._pool.submit(self._store.compact, self.run, self._hotsize, self.step, self._store.log_files(self.run))

    def _check(self) -> None:
        if not self._open:
            raise RuntimeError("the writer is finished")
        if self._compaction is not None and self._compaction.done():
            done, self._compaction = self._compaction, None
            done.result()

    def _append(self) -> None:
        if self._file is None:
            self._file = self._store.new_log_file(self.run).open("w", encoding="utf-8")
            self._in_file = 0
        self._seq += 1
        self._file.write(json.dumps({"seq": self._seq, "step": self.step, "values": list(self._row.values())}, ensure_ascii=False) + "\n")
        self._file.flush()
        self._in_file += 1
        if self._in_file >= self._file_rows:
            self._close_file()

    def _close_file(self) -> None:
        if self._file is not None:
            os.fsync(self._file.fileno())
            self._file.close()
            self._file = None

    def set_config(self, config: dict | str | None) -> None:
        """Replace the run's config: by a dict, or by a link to a JSON file. None, or a file that isn't there, keeps what there is."""
        self._store.describe(self.run, **_config(config))

    def finish(self, optimize: bool = True) -> None:
        """Compact everything and describe the run; a run without values is left as it is."""
        self._check()
        if self._row:
            self._append()
        self._close_file()
        self._open = False
        if self._pool is not None:
            self._pool.shutdown(wait=True)
            if self._compaction is not None:
                self._compaction.result()
        self._store.finish(self.run, optimize)


class RunStore:
    """Runs below a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)

    def _entry(self, run: str) -> Path:
        return self.root / "runs" / f"{quote(run, safe='')}.json"

    def _log(self, run: str, version: str | None = None) -> Path:
        return self.root / "log" / f"run={quote(run, safe='')}" / (version or self.described(run).get("version", "first"))

    def _cold(self, run: str, version: str | None = None) -> Path:
        return self.root / "points" / f"run={quote(run, safe='')}" / (version or self.described(run).get("version", "first"))

    def runs(self) -> list[str]:
        return sorted(unquote(p.stem) for p in (self.root / "runs").glob("*.json"))

    def described(self, run: str) -> dict:
        return json.loads(self._entry(run).read_text()) if self._entry(run).exists() else {}

    def describe(self, run: str, without: tuple[str, ...] = (), **entries: Any) -> None:
        """Change a catalog entry, at once: set some keys, drop others."""
        self._entry(run).parent.mkdir(parents=True, exist_ok=True)
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        kept = {k: v for k, v in self.described(run).items() if k not in without}
        replace_text(self._entry(run), json.dumps({**kept, **entries, "when_exported": now}))

    def writer(self, run: str, step: int = 0, file_rows: int = 100, config: dict | str | None = None, resume_finished: bool = False, discard_all: bool = False, hotsize: int | None = None) -> RowWriter:
        """Log a run, or go on with one from `step`: what it has from there on is deleted.

        To go on at step 0 deletes all, so `discard_all` must say so; a finished
        run needs `resume_finished`. Its integers have the smallest types that
        hold them; when it goes on they are 64 bits wide again.
        """
        known = self.described(run)
        if known.get("finished") and not resume_finished:
            raise RuntimeError(f"{run} is finished; pass resume_finished=True to go on with it")
        if known:
            self.truncate(run, step, allow_empty=discard_all)
        self.describe(run, **({"config": {}} if "config" not in known else {}) | _config(config), finished=False)
        return RowWriter(self, run, step, file_rows, hotsize)

    def new_log_file(self, run: str) -> Path:
        """A name after all log files there are."""
        folder = self._log(run)
        folder.mkdir(parents=True, exist_ok=True)
        last = max((int(p.name.split("-")[0]) for p in folder.glob("*.json")), default=-1)
        return folder / f"{last + 1:09d}-{uuid.uuid4().hex[:8]}.json"

    def _read_log(self, run: str, files: list[Path]) -> DataFrame:
        """(run, file, seq, step, values) of log files; of a step written again, the last row.

        A line that was cut off when its writer died, at the end of a file, is
        left out; any other line that doesn't parse raises.
        """
        files = [f for f in files if f.stat().st_size]
        if not files:
            return self.spark.createDataFrame([], f"run string, file string, {LOG_SCHEMA}")
        torn = [t for t in map(_torn, files) if t is not None]
        rows = self.spark.read.schema(f"{LOG_SCHEMA}, __bad string").option("columnNameOfCorruptRecord", "__bad").json([str(f) for f in files])
        rows = rows.select(F.lit(run).alias("run"), F.col("_metadata.file_name").alias("file"), "seq", "step", "values", "__bad")
        cut = F.col("__bad").isin(torn) if torn else F.lit(False)
        rows = rows.where(F.col("__bad").isNull() | ~cut)
        guarded = F.when(F.col("__bad").isNotNull(), F.raise_error(F.concat(F.lit("bad line in "), F.col("file"), F.lit(": "), F.col("__bad"))).cast("bigint")).otherwise(F.col("step"))
        rows = rows.withColumn("step", guarded).drop("__bad")
        return rows.groupBy("run", "step").agg(F.max_by(F.struct("file", "seq", "values"), F.struct("file", "seq")).alias("r")).select("run", "r.file", "r.seq", "step", "r.values")

    def log(self, run: str) -> DataFrame:
        """(run, file, seq, step, values) of rows that aren't compacted."""
        return self._read_log(run, self.log_files(run))

    def hot(self, run: str) -> DataFrame:
        return _points_of(self.log(run))

    def cold(self, run: str) -> DataFrame:
        if not any(self._cold(run).glob("*.parquet")):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.parquet(str(self._cold(run))).select(F.lit(run).alias("run"), *COLUMNS[1:])

    def points(self, run: str) -> DataFrame:
        hot = self.hot(run)  # before the columns, see merge.merge
        return merge.merge(self.cold(run), hot)

    def _put_log(self, rows: DataFrame, folder: Path, first: int) -> None:
        """Write rows (seq, step, values) as log files with that number; they appear whole."""
        draft = folder.with_name(f".{uuid.uuid4().hex}")
        rows.select("seq", "step", "values").write.json(str(draft))
        folder.mkdir(parents=True, exist_ok=True)
        for file in sorted(draft.glob("*.json")):
            if file.stat().st_size:
                file.replace(folder / f"{first:09d}-{uuid.uuid4().hex[:8]}.json")
        shutil.rmtree(draft)

    def log_files(self, run: str) -> list[Path]:
        return sorted(self._log(run).glob("*.json"))

    def compact(self, run: str, hotsize: int, current_step: int, files: list[Path] | None = None) -> int:
        """Move the oldest `hotsize` rows below the current step to columns, if there are so many; the rows moved.

        Exactly `files` are read, and deleted in the end; what a writer adds
        meanwhile stays. Unless they are given, they are all but the last, which
        a writer may have open. Points are written first,
        then the rest of these files as new ones; in between, rows are there
        twice, which reading hides.
        """
        files = self.log_files(run)[:-1] if files is None else files
        rows = self._read_log(run, files).cache()
        try:
            steps = [r["step"] for r in merge.compaction_batch(rows, hotsize, current_step).select("step").collect()]  # hotsize at most
            if not steps:
                return 0
            last = max(steps)  # the batch is the oldest rows
            before = self.cold(run)
            kept = before.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).select(F.col("metric").alias("m"), "n")
            fresh = merge.merge(before, _points_of(rows.where(F.col("step") <= last)))
            fresh = fresh.join(kept, F.col("metric") == F.col("m"), "left").where(F.col("pos") >= F.coalesce("n", F.lit(0))).select(*COLUMNS).cache()
            longest = fresh.agg(F.max("pos")).first()[0]
            fresh.drop("run").sortWithinPartitions("metric", "pos").write.mode("append").parquet(str(self._cold(run)))
            fresh.unpersist()
            left = rows.where(F.col("step") > last)
            if not left.isEmpty():
                self._put_log(left, self._log(run), int(files[0].name.split("-")[0]))
            for file in files:
                file.unlink()
            if longest is not None:
                self.describe(run, cold_rows=max(longest + 1, self.described(run).get("cold_rows", 0)))
            return len(steps)
        finally:
            rows.unpersist()

    def _switch(self, run: str, version: str, without: tuple[str, ...] = (), **entries: Any) -> None:
        """Let the catalog point to a new version, then delete the others."""
        self.describe(run, without, version=version, **entries)
        for folder in (self._log(run, version).parent, self._cold(run, version).parent):
            for old in folder.glob("*"):
                if old.name != version:
                    shutil.rmtree(old, ignore_errors=True)

    def truncate(self, run: str, step: int, allow_empty: bool = False) -> None:
        """Delete what a run has from `step` on; what is left in the log goes before compacted points.

        What the catalog says of counts, directions and segments goes, too; types stay.
        """
        cold, hot = rewind.recover(self.cold(run), self.hot(run), step, allow_empty)
        version = uuid.uuid4().hex
        left = hot.groupBy("run", "step").agg(F.collect_list(F.struct("metric", "dtype", "num", "ival", "json")).alias("values"))
        self._put_log(left.withColumn("seq", F.lit(0)), self._log(run, version), 0)
        cold.drop("run").write.parquet(str(self._cold(run, version)))
        longest = self.spark.read.schema("pos bigint").parquet(str(self._cold(run, version))).agg(F.max("pos")).first()[0]
        types = {m: {"dtype": _widest(spec["dtype"])} for m, spec in self.described(run).get("metrics", {}).items()}
        self._switch(run, version, ("run_rows",), metrics=types, cold_rows=0 if longest is None else longest + 1, finished=False)

    def finish(self, run: str, optimize: bool = True) -> None:
        """Compact all of a run and write its catalog entry."""
        points = self.points(run).cache()
        try:
            if points.isEmpty():
                return
            metrics = describe(points, optimize)
            version = uuid.uuid4().hex
            points.drop("run").repartitionByRange("metric", "pos").sortWithinPartitions("metric", "pos").write.parquet(str(self._cold(run, version)))
            longest = rows_per_metric(points).agg(F.max("n")).first()[0]
        finally:
            points.unpersist()
        self._switch(run, version, () if optimize else ("run_rows",), metrics=metrics, finished=True, cold_rows=longest, config=self.config(run), **({"run_rows": longest} if optimize else {}))

    def export(self, run: str, path: str, name: str = "runlog", optimize: bool = True, archive: bool = True) -> None:
        """Write a run as an archive or folder in the on-disk format."""
        export_run(self.points(run), path, name, self.config(run), optimize, archive)

    def config(self, run: str) -> dict:
        """The run's config; of a linked file, as it is now."""
        known = self.described(run)
        link = Path(known["config_link"]) if known.get("config_link") else None
        return json.loads(link.read_text()) if link and link.exists() else known.get("config", {})

    def when_exported(self, run: str) -> str | None:
        return self.described(run).get("when_exported")

    def metrics(self, run: str) -> list[str]:
        names = self.points(run).select("metric").distinct().collect()
        return sorted({r["metric"] for r in names} | set(self.described(run).get("metrics", {})))

    def dtype(self, run: str, name: str) -> str:
        known = self.described(run).get("metrics", {}).get(name)
        if known:
            return known["dtype"]
        first = self.points(run).where(F.col("metric") == name).select("dtype").first()
        if first is None:
            raise KeyError(name)
        return first["dtype"]

    def metric(self, run: str, name: str, idx: int | slice | list[int] | None = None, **bounds) -> DataFrame:
        """(pos, step, value) of a metric in a range, or what is at place or places `idx` of it.

        KeyError if the run has no such metric, IndexError if `idx` is out of range.
        """
        selected = select_metric(self.points(run), name, self.dtype(run, name), **bounds)
        if idx is None:
            return selected
        if not isinstance(idx, int):
            return pick_many(selected, idx)
        one = pick(selected, idx)
        if one.isEmpty():
            raise IndexError(f"{name} has no row {idx} there")
        return one

    def rows(self, run: str, name: str) -> int:
        if name not in self.metrics(run):
            raise KeyError(name)
        return self.points(run).where(F.col("metric") == name).count()

    def approx_max_rows(self, run: str, faster: bool = True) -> int:
        """Rows of the longest metric: as the catalog has it, which doesn't know of the log, or counted with the log."""
        known = self.described(run)
        if known.get("run_rows") is not None:
            return known["run_rows"]
        return known.get("cold_rows", 0) if faster else rows_per_metric(self.points(run)).agg(F.max("n")).first()[0] or 0


def _points_of(rows: DataFrame) -> DataFrame:
    values = rows.select("run", "step", F.explode("values").alias("v"))
    return values.select("run", "v.metric", F.col("step").alias("pos"), "step", "v.dtype", "v.num", "v.ival", "v.json")


def _torn(file: Path) -> str | None:
    """What stands behind the last line end of a file; None if nothing does."""
    with file.open("rb") as f:
        at, tail = f.seek(0, os.SEEK_END), b""
        while at and b"\n" not in tail:
            step = min(at, 1 << 16)
            at = f.seek(at - step)
            tail = f.read(step) + tail
    return tail.rsplit(b"\n", 1)[-1].decode("utf-8", "replace") or None


def _widest(dtype: str) -> str:
    """The type that a metric has while it is logged: integers are i64, but for u64."""
    return "i64" if dtype in (*SIGNED, *UNSIGNED) and dtype != "u64" else dtype


def _config(config: dict | str | None) -> dict[str, Any]:
    """The catalog's entries for a config that was given; none to keep what there is."""
    if isinstance(config, dict):
        return {"config": config, "config_link": None}
    if config is None or not Path(config).exists():
        return {}
    return {"config": json.loads(Path(config).read_text()), "config_link": str(Path(config).resolve())}
