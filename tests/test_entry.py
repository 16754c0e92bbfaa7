import os

import duckdb
import pytest

import __spark_entry__ as entry
from wakeline import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).map(lambda x: str(x).removesuffix(" 00:00:00").removesuffix(".0")).values.tolist()))


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@needs_data
def test_positions_are_gathered_by_day(spark, monkeypatch):
    frames = []
    whole = catalog.identities
    monkeypatch.setattr(catalog, "identities", lambda *a, **k: frames.append(whole(*a, **k)) or frames[-1])
    assert catalog.identity_positions(spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert all(len({p["ts"].date() for p in r["Positions"]}) == 1 for f in frames for r in f.collect())


@needs_data
def test_positions_with_nulls(spark, tmp_path):
    stamps = ["2024-01-02 05:00:00", "2024-01-01 05:00:00", None, "2024-01-02 04:00:00", "2024-01-03 04:00:00", None]
    values = [(n, t, u, e, float(n), "{}") for n, (t, (u, e)) in enumerate((t, k) for t in stamps for k in ((1, "a"), (None, "a"), (1, None)))]
    frame = spark.createDataFrame(values, "event_id long, t string, user_id long, event_type string, value double, props string")
    frame.selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = [(r["event_id"], r["pos"]) for r in catalog.identity_positions(spark, str(tmp_path)).collect()]
    assert sorted(got) == con.execute(f"SELECT event_id, pos FROM ({catalog.ORACLE_SQL['identity_positions']}) ORDER BY 1").fetchall()


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
