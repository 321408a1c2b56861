"""Driver contract, every registered query on sf0.001, plan shape of the text path."""

import os
import re
import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT, SF
from pyspark.sql import functions as F

import __spark_entry__ as E

sys.path.insert(0, os.path.join(ROOT, "tools"))
from check_oracle import TABLES, canon  # noqa: E402
from docprep.functions.compact import compact_markdown
from docprep.functions.html import html_to_markdown


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and {r.platform for r in rows} == {"chatgpt", "claude", "gemini", "kimi"}


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    want = duck.execute(E.oracle_sql()[name])
    assert canon(df.columns, df.collect()) == canon([c[0] for c in want.description], want.fetchall())


def test_queries_without_sql_are_of_the_training_data_part():
    """Those are held against plain versions of themselves in tests/llm."""
    assert all(re.fullmatch("op[0-9]+_.*|pipeline", n) for n in set(E.queries()) - set(E.oracle_sql()))


def test_entry_without_the_training_data_part(tmp_path):
    """A missing import of that part, its own or a package it needs, leaves the other queries as they are."""
    for name in ("docprep.llm", "public_tokenizers", "ahocorasick"):
        code = f"import sys; sys.modules['{name}'] = None; import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
        root = os.path.dirname(E.__file__)
        out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[-1]) == len([n for n in E.oracle_sql() if not n.startswith("op")]) and int(out[-2]) >= int(out[-1])


def test_text_path_has_no_exchange_or_python(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plan = d.select(compact_markdown(F.col("text")).alias("m"), html_to_markdown(F.col("text")).alias("h"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_scan_prunes_columns(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plan = d.select(compact_markdown(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
