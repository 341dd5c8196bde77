"""Registered queries: a sample runs beside its SQL; the contract holds for all."""

import importlib
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tools.check import TABLES, rows_of

entry = importlib.import_module("__spark_entry__")
SAMPLE = ["survey_translate", "smooth_needs", "risk_by_debt", "constraints_repair", "score_stats", "roc_auc", "knn_exact", "stratified_split", "silhouette_1d"]


def test_contract(spark):
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries) and len(queries) > 100
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_other_queries_stand_without_the_optional_part():
    code = "import sys\nsys.modules.update({'zstandard': None, 'xxhash': None})\nimport __spark_entry__ as e\nprint(len(e.queries()), sum(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and int(out[1]) == 0
