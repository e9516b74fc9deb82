"""Every query with SQL gives the same rows in a second engine; every other gives rows."""

import collections
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from turnloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(df: pd.DataFrame) -> collections.Counter:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return collections.Counter(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), db.execute(catalogue.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    for frame in (got, want):
        for c in frame.columns:
            if frame[c].dtype.kind in "iufb":
                frame[c] = frame[c].map(lambda v: v.item() if hasattr(v, "item") else v).astype(object)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).limit(1).count() == 1


def test_reasoning_samples_of_all_events(spark):
    events = catalogue.turns.event_table(catalogue.dialogues(spark, DATA))
    got = catalogue.QUERIES["reasoning_samples"](spark, DATA).toPandas()
    assert len(got) == events.count() and not got.duplicated(["rec_id", "turn_no", "event_no"]).any()
    assert got[got["rec_id"] % 50 != 0]["input"].str.startswith("(example)").any()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
