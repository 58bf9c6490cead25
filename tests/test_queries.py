"""Every table query against its SQL, and the entry without the training-data operators."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quarrylog.queries import QUERIES, SQL

from .test_functions import plain_template

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(None if x != x else x for x in r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


def test_queries_without_sql():
    assert set(QUERIES) - set(SQL) == {"templates_of_text"}


def test_templates_of_text(spark, sql):
    want = {(c, t): plain_template(re.sub(r"[ \t\n\f\r]+", " ", x or "").strip(" ")) for c, t, x in sql.sql("select conv_id, turn, text from conversations").fetchall()}
    assert {(r.conv_id, r.turn): r.template or "" for r in QUERIES["templates_of_text"](spark, DIR).collect()} == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sql, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), sql.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_without_training_operators(tmp_path):
    shutil.copytree(ROOT / "quarrylog", tmp_path / "quarrylog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and set(q) - set(e.oracle_sql()) == {'templates_of_text'} and len(q) > 30"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_them():
    for f in (ROOT / "quarrylog").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
