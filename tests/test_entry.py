import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    if importlib.util.find_spec("runweave.llm") is not None and importlib.util.find_spec("corpus_pipeline") is not None:
        assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in queries} and "pipeline" in queries


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    found, wanted = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in found.columns]
    plain = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    got = sorted((tuple(plain(v) for v in r) for r in found.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in wanted.fetchall()), key=repr)


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_subpackage(tmp_path, pipeline):
    """The training-data operators and their tests may be deleted, with the pipeline or without it."""
    root = Path(entry.__file__).resolve().parent
    for name in ("runweave", "tests", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (root / "corpus_pipeline.py").exists() else [])):
        copy = shutil.copytree if (root / name).is_dir() else shutil.copy
        copy(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "runweave" / "llm", ignore_errors=True)
    shutil.rmtree(tmp_path / "tests" / "llm", ignore_errors=True)
    said = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and set(e.oracle_sql()) == set(q) and not any(n.startswith(('op', 'pipeline')) for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for command in ([sys.executable, "-c", said], [sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"]):
        done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stdout + done.stderr
