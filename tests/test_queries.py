"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from weirflow.plans.oracles import ORACLES
from weirflow.plans.queries import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    ours, theirs = queries()[name](spark, str(DATA)).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_survives_without_the_other_subpackage():
    import __spark_entry__ as e

    assert set(queries()) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_gates_are_asked_of_rows_written_once(spark, monkeypatch):
    """No gate makes keys and classes again: each gets the table that the rows were written to."""
    from weirflow.plans import queries as q

    plans = []

    def sync(rows, *a, **k):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return {"executed": False, "reason": None, "counts": None, "report": None}

    monkeypatch.setattr(q.pipeline, "sync", sync)
    q.sync_not_attempted(spark, str(DATA))
    assert len(plans) == 5 and all("Window" not in p and "Exchange" not in p and p.count("FileScan") == 1 for p in plans)
