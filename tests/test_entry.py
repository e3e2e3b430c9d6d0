"""The contract functions and the queries outside the llm folders, against their SQL."""

import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT, SMALL

import __spark_entry__ as contract
from gristmill.sources import read_table


def rows(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()))


def test_lineitem_summary_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet'")
    out = con.execute(contract.oracle_sql()["lineitem_summary"])
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert rows(contract.queries()["lineitem_summary"](spark, SMALL)) == sorted(tuple(r[i] for i in order) for r in out.fetchall())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_naive_timestamps_stay_naive(spark):
    assert dict(read_table(spark, SMALL, "lineitem").dtypes)["l_shipdate"] == "timestamp_ntz"


@pytest.mark.parametrize("name", ["xxhash", "tokenizers_of_nobody"])
def test_entry_survives_what_is_not_installed(name):
    code = f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; print(*e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    names = said.stdout.split()
    assert "lineitem_summary" in names and (name != "xxhash" or names == ["lineitem_summary"] and "xxhash" in said.stderr)
