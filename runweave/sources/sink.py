"""Writing a run in the on-disk format that `rundir` reads."""

from __future__ import annotations

import datetime
import json
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions.types import JSON, KINDS, tightest
from runweave.operators.monotonic import direction
from runweave.operators.points import rows_per_metric
from runweave.operators.segments import index_mode, segment


def replace_text(path: Path, text: str) -> None:
    """Write a file at once: readers see the old or the new one, and it is on disk when this returns."""
    if not text:
        raise ValueError(f"nothing to write to {path}")
    draft = path.with_name(f".{path.name}.{os.getpid()}")
    with draft.open("w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    draft.replace(path)
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def describe(points: DataFrame, optimize: bool = True) -> dict[str, dict]:
    """The manifest entry of each metric of one run: dtype, indices and, for numbers, whether they rise or fall.

    With `optimize` integers get the smallest type that holds them, and steps
    are segments where those are few.
    """
    of: dict[str, dict] = {}
    for r in points.groupBy("metric").agg(F.first("dtype").alias("dtype"), F.min("ival").alias("low"), F.max("ival").alias("high")).collect():
        dtype = r["dtype"]
        if optimize and r["low"] is not None:
            dtype = tightest(int(r["low"]), int(r["high"]))
        of[r["metric"]] = {"indices": "indices", "dtype": dtype}
    for r in direction(points).where("monotonic is not null").collect():
        of[r["metric"]]["monotonic"] = r["monotonic"]
    if optimize:
        found = segment(points)
        few = index_mode(found).where("mode = 'segments'").select("run", "metric")
        parts: dict[str, list[dict]] = {}
        for r in found.join(few, ["run", "metric"]).orderBy("metric", "start").toLocalIterator():
            parts.setdefault(r["metric"], []).append({"start": r["start"], "stop": r["stop"], "step": r["stride"]})
        for metric, segments in parts.items():
            of[metric]["indices"] = segments
    return of


def export_run(points: DataFrame, path: str, name: str = "runlog", config: dict | None = None, optimize: bool = True, archive: bool = True) -> None:
    """Write the points of one run as an archive at `path`, or a folder `path`/`name`.

    Values come to the driver a metric after the other, in order of pos, and are
    appended to its files; nothing is held but a part of one metric. Without
    points nothing is written.
    """
    points = points.cache()
    try:
        manifest = describe(points, optimize)
        if not manifest:
            return
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        with tempfile.TemporaryDirectory(dir=target.parent) as draft:
            root = Path(draft) / name
            root.mkdir()
            longest = rows_per_metric(points).agg(F.max("n")).first()[0]
            for metric, spec in manifest.items():
                _write_metric(points.where(F.col("metric") == metric).orderBy("pos"), root / metric, spec)
            now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            replace_text(root / f"{name}.json", json.dumps({**dict(sorted(manifest.items())), **({"run_rows": longest} if optimize else {}), "when_exported": now}))
            replace_text(root / "config.json", json.dumps(config or {}))
            if archive:
                pack(root, target)
            else:
                final = target / name
                shutil.rmtree(final, ignore_errors=True)
                target.mkdir(parents=True, exist_ok=True)
                shutil.move(str(root), final)
    finally:
        points.unpersist()


def _write_metric(rows: DataFrame, base: Path, spec: dict) -> None:
    base.parent.mkdir(parents=True, exist_ok=True)
    dtype = spec["dtype"]
    steps = base.with_name(f"{base.name}.indices").open("wb") if spec["indices"] == "indices" else None
    with base.with_name(f"{base.name}.{dtype}").open("wb") as values:
        batch: list = []

        def flush() -> None:
            if dtype == JSON:
                values.write("".join(f"{r['json']}\n" for r in batch).encode())
            else:
                values.write(np.array([r["num"] if dtype[0] == "f" else int(r["ival"]) for r in batch], dtype=KINDS[dtype].code).tobytes())
            if steps is not None:
                steps.write(np.array([r["step"] for r in batch], dtype="<u4").tobytes())
            batch.clear()

        for r in rows.select("step", "num", "ival", "json").toLocalIterator():
            batch.append(r)
            if len(batch) >= 1 << 16:
                flush()
        flush()
    if steps is not None:
        steps.close()


def pack(root: Path, target: Path) -> None:
    """The files of a folder as an uncompressed zip, in order of name, which appears at once."""
    draft = target.with_name(f".{target.name}.{os.getpid()}")
    with zipfile.ZipFile(draft, "w", zipfile.ZIP_STORED) as z:
        for file in sorted(p for p in root.rglob("*") if p.is_file()):
            z.write(file.resolve(), file.relative_to(root))
    draft.replace(target)
