import datetime as dt
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from wakeline import catalog, cli, reporting
from wakeline.operators.identities import identities, write_identities
from wakeline.operators.predicates import TrackQuery, all_of, any_of, day_counts, group_counts, semi_join
from wakeline.plans.metrics import pruning, scan_metrics
from wakeline.plans import sweep
from wakeline.plans.planner import describe, plan
from wakeline.plans.queryset import queries
from wakeline.schema import RAW_COLUMNS, TYPED
from wakeline.sources.csv_ingest import ingest, read_lines, skipped_lines
from wakeline.sources.layouts import LAYOUTS, Layout, bloom_columns, footers, parse_ndv, read_layout, smart_row_group_rows, write_layout, write_layouts
from wakeline.streaming.ingest import ingest_new


def ts(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def positions(spark):
    rng = random.Random(5)
    rows = []
    for n in range(4000):
        when = ts("2024-10-10") + dt.timedelta(minutes=rng.randrange(60 * 24 * 25))
        mmsi = rng.choice([563073700, 248669000, 367481310, 1, 2, 3])
        name = rng.choice(["MAERSK MEMPHIS", "MAERSK X", "SPIRIT OF SEA", None, "maersk"])
        rows.append((mmsi, when if n % 97 else None, rng.choice([rng.uniform(24, 50), None]), rng.uniform(-125, -70), 1.0, 2.0, 3.0, name, rng.choice([9348651, 1, None]),
                     rng.choice(["WDK6270", "WDK1", None]), rng.choice(["70", "80", None]), "0", 10.0, 5.0, None, "x", rng.choice([True, False, None])))
    return spark.createDataFrame(rows, TYPED).cache()


def test_query_set_against_duckdb(positions):
    table = positions.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("p", table)
    want = {
        "mmsi multi": "MMSI IN (563073700,248669000,367481310,367776660,319194000)", "vessel name prefix": "starts_with(VesselName,'MAERSK')",
        "single day": "BaseDateTime >= '2024-10-20' AND BaseDateTime < '2024-10-21'", "vessel name substring": "contains(VesselName,'SPIRIT')",
        "gulf of mexico": "LAT BETWEEN 25 AND 31 AND LON BETWEEN -96 AND -80", "vessel type and box": "VesselType='70' AND LAT BETWEEN 25 AND 31 AND LON BETWEEN -96 AND -80",
        "imo placeholder": "IMO = 1", "call sign absent": "CallSign='ZZZZZZZZ'", "count all": "true",
    }
    qs = {q.name: q for q in queries()}
    assert len(qs) == 31
    for name, where in want.items():
        n = con.execute(f"SELECT count(*) FROM p WHERE {where}").fetchone()[0]
        assert qs[name].run(positions).first()["n"] == n, name
    for name, sql in (("vessel types", "count(DISTINCT VesselType)"), ("days", "count(DISTINCT BaseDateTime::DATE)"), ("distinct mmsi", "count(DISTINCT MMSI)")):
        assert qs[name].run(positions).first()["n"] == con.execute(f"SELECT {sql} FROM p").fetchone()[0]
    assert qs["mmsi exact"].run(positions).columns == list(RAW_COLUMNS)


def test_all_layouts_agree_and_prune(spark, positions, tmp_path):
    held = write_layouts(positions, str(tmp_path), list(LAYOUTS.values()))
    assert held["partitioned_curve"].bounds is not None
    timings = []
    for name in LAYOUTS:
        df, layout = read_layout(spark, f"{tmp_path}/{name}")
        assert df.count() == 4000  # rows without a time included
        for q in queries()[::3] + [q for q in queries() if q.category in ("box", "time", "combined")]:
            planned = plan(df, q, layout)
            n = planned.count() if q.operation == "rows" else planned.first()["n"]
            plain = q.run(df)
            assert n == (plain.count() if q.operation == "rows" else plain.first()["n"]), (name, q.name)
            timings.append(reporting.Timing(q.name, name, n, [1.0]))
    reporting.check_consistency(timings)
    day = next(q for q in queries() if q.name == "single day")
    df, layout = read_layout(spark, f"{tmp_path}/partitioned")
    text = plan(df, day, layout)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "make_date" in text.split("PartitionFilters")[1].split("]")[0]
    assert scan_metrics(plan(df, day, layout))["files"] < 3
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_layout(positions, f"{tmp_path}/partitioned", LAYOUTS["partitioned"])


def test_curve_layout_reads_fewer_rows(spark, tmp_path):
    df = spark.range(40_000).select((F.rand(1) * 25 + 25).cast("float").alias("LAT"), (F.rand(2) * 50 - 120).cast("float").alias("LON"), F.lit(ts("2024-10-20")).alias("BaseDateTime"))
    write_layout(df.coalesce(1), str(tmp_path / "c"), Layout("c", curve="hilbert2d", row_group_rows=1000))
    held, layout = read_layout(spark, str(tmp_path / "c"))
    q = TrackQuery().box((30, 32), (-100, -98))
    planned = plan(held, q, layout)
    assert planned.first()["n"] == q.run(df).first()["n"]
    assert scan_metrics(planned)["rows"] < 8_000


def test_unpartitioned_curve_layout_is_in_order_and_days_spread(spark, tmp_path):
    df = spark.range(40_000).select((F.rand(1) * 25 + 25).cast("float").alias("LAT"), (F.rand(2) * 50 - 120).cast("float").alias("LON"), F.lit(ts("2024-10-20")).alias("BaseDateTime"))
    write_layout(df, str(tmp_path / "u"), Layout("u", partitioned=False, curve="hilbert2d", row_group_rows=1000))
    held, layout = read_layout(spark, str(tmp_path / "u"), view="u")
    assert spark.sql("SELECT count(*) AS n FROM u").first()["n"] == 40_000
    q = TrackQuery().box((30, 32), (-100, -98))
    assert plan(held, q, layout).first()["n"] == q.run(df).first()["n"]
    assert scan_metrics(plan(held, q, layout))["rows"] < 8_000 and scan_metrics(held.where("LAT is not null"))["rows"] == 40_000
    # One day, many files, each with a range of keys of its own.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the day is small for a test
    write_layout(df, str(tmp_path / "d"), Layout("d", curve="hilbert2d"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = read_layout(spark, str(tmp_path / "d"))[0].groupBy(F.input_file_name()).agg(F.min("curve_key").alias("a"), F.max("curve_key").alias("b")).orderBy("a").collect()
    assert len(spans) > 1 and all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:]))


def test_small_row_groups_are_read_without_page_index(spark, tmp_path):
    df = spark.range(40_000).select((F.rand(1) * 25 + 25).alias("LAT"), (F.rand(2) * 50 - 120).alias("LON"), F.lit(ts("2024-10-20")).alias("BaseDateTime"))
    path = str(tmp_path / "s")
    write_layout(df.coalesce(1), path, Layout("s", partitioned=False, curve="hilbert2d", row_group_rows=20, page_bytes=4096))

    def taken(read) -> int:
        """Bytes that a scan of all rows takes from the file system."""
        held = lambda: sum(x.getBytesRead() for x in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
        start = held()
        assert scan_metrics(read.where("LAT is not null"))["rows"] == 40_000
        return held() - start

    size = sum(f.stat().st_size for f in (tmp_path / "s").glob("*.parquet"))
    own, layout = read_layout(spark, path)
    assert taken(own) < 3 * size < taken(spark.read.parquet(path))
    assert layout.reader_options() and not Layout("large").reader_options() and not Layout("pages", row_group_rows=1000, page_bytes=4096).reader_options()
    q = TrackQuery().box((30, 32), (-100, -98))
    assert scan_metrics(plan(own, q, layout)) == scan_metrics(plan(spark.read.parquet(path), q, layout))


def test_spared_rows_are_held_against_the_whole_box(spark, tmp_path):
    """Where the table as it came has the box's rows side by side, its own statistics spare as much as the layout."""
    part = (F.col("id") % 50 + 1).cast("double").alias("l_quantity"), (F.col("id") * 7919 % 20_000 * 5).cast("double").alias("l_extendedprice")
    rows = spark.range(20_000).select(*part, F.lit(ts("1997-01-01")).alias("l_shipdate"))
    side = [F.when(F.col(c) < low, 0).when(F.col(c) <= high, 1).otherwise(2) for c, low, high in (("l_extendedprice", 20_000, 40_000), ("l_quantity", 10, 20))]
    n = rows.where((side[0] == 1) & (side[1] == 1)).count()
    for name, order, spares in (("mixed", [F.xxhash64("l_extendedprice")], True), ("together", side, False)):
        rows.coalesce(1).sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", "100").parquet(str(tmp_path / name / "lineitem.parquet"))
        assert tuple(catalog.QUERIES["layout_skipping"](spark, str(tmp_path / name)).first()) == (n, spares)


def test_counts_and_bounds_come_from_footers(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as double) as x").write.parquet(str(tmp_path / "t"))
    own = footers(spark)
    got = own.read.parquet(str(tmp_path / "t")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    assert tuple(got.first()) == (1000, 0.0, 999.0)
    assert "PushedAggregation: [COUNT(*), MIN(x), MAX(x)]" in got._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_plan_descriptions():
    q = TrackQuery().box((30, 32), (-100, -98)).during("2024-01-01", "2024-01-02").closing("groups", "VesselType")
    layout = Layout("x", curve="hilbert2d", blooms=("MMSI",), bounds=((0, 90), (-180, 180)))
    assert describe(q, layout) == [
        "row group statistics + day partitions + bloom filters of MMSI + hilbert2d curve intervals", "implied: days of the time range", "implied: curve intervals of the box",
        "filter: Range on LAT", "filter: Range on LON", "filter: Between on BaseDateTime", "operation: groups of VesselType",
    ]
    assert describe(TrackQuery(), LAYOUTS["monolithic"]) == ["row group statistics", "operation: count"]


def test_sweep(spark, positions, tmp_path):
    assert [len([c for c in sweep.cells() if c.experiment == x]) for x in ("row groups x pages", "bloom rate x values", "combined")] == [12, 9, 2]
    assert all(sum(c.default for c in sweep.cells() if c.experiment == x.experiment) == 1 for x in sweep.cells())
    chosen = [c for c in sweep.cells() if c.name in ("1M-1048576", "1M-1MB", "100K-64K", "100K-64KB", "optimal-all", "baseline-all")]
    assert len(chosen) == 4
    few = [q for q in queries() if q.name in ("mmsi multi", "gulf of mexico", "count all")]
    sweep.run(spark, positions, str(tmp_path), chosen, few, repeats=1, warmups=0)
    found = sweep.results(spark, str(tmp_path))
    assert found.count() == 12 and found.groupBy("query").agg(F.count_distinct("n").alias("k")).where("k > 1").count() == 0
    before = found.agg(F.sum("seconds")).first()[0]
    sweep.run(spark, positions, str(tmp_path), chosen, few)  # all have results
    assert sweep.results(spark, str(tmp_path)).agg(F.sum("seconds")).first()[0] == before
    text = sweep.report(spark, str(tmp_path))
    assert "| 1M | - | - | 1.00x |" in text and "No results." in text and "| baseline | 1.00x |" in text


def test_speedup_of_a_slower_cell(spark):
    rows = [("e", "a", "x", True, "q", 1, 1.0), ("e", "b", "x", False, "q", 1, 2.0)]
    found = sweep.speedups(spark.createDataFrame(rows, "experiment string, row string, column string, standard boolean, query string, n long, seconds double"))
    assert {r["row"]: r["speedup"] for r in found.collect()} == {"a": 1.0, "b": 0.5}


def test_bloom_filters_prune(spark, tmp_path):
    df = spark.range(50_000).select((F.col("id") * 7919 % 1_000_003).alias("MMSI"), F.lit("x").alias("v"))
    path = str(tmp_path / "b")
    write_layout(df.coalesce(1), path, Layout("b", partitioned=False, blooms=("MMSI",), row_group_rows=5_000, bloom_ndv=5_000))
    groups = duckdb.execute(f"SELECT count(*), count(bloom_filter_offset) FROM parquet_metadata('{path}/*.parquet') WHERE path_in_schema='MMSI'").fetchone()
    assert groups[0] == groups[1] == 10
    got = pruning(spark, path, lambda d: d.where("MMSI = 7919").groupBy().count())
    assert got["rows"] <= 10_000 < got["rows_without_bloom"]


def test_layout_options():
    assert bloom_columns("CallSign", "IMO") == ("MMSI", "IMO", "CallSign")
    assert parse_ndv("MMSI=5") == ("MMSI", 5)
    with pytest.raises(ValueError):
        parse_ndv("MMSI")


def test_smart_row_groups(positions):
    days = positions.select(F.count_distinct(F.to_date("BaseDateTime"))).first()[0]
    assert smart_row_group_rows(positions, 10**9) == 4000 // days // 5
    assert smart_row_group_rows(positions, 3) == 3
    assert smart_row_group_rows(positions.limit(0), 3) == 1


def test_identities(spark, tmp_path):
    rows = [
        (1, None, "A", "N", ts("2024-01-01T00:00:02"), 1.0, None, None),
        (1, None, "A", "N", ts("2024-01-01T00:00:01"), 2.0, 9.0, True),
        (1, None, "A", "N", None, None, 7.0, None),
        (1, None, "A", None, ts("2024-01-02"), 5.0, 6.0, False),
        (-4, 5, None, None, ts("2024-01-02"), 5.0, 6.0, False),
    ]
    df = spark.createDataFrame(rows, "MMSI long, IMO long, CallSign string, VesselName string, BaseDateTime timestamp_ntz, LAT float, LON float, TransceiverClass boolean")
    for c in ("SOG", "COG", "Heading", "Draft", "Length", "Width"):
        df = df.withColumn(c, F.lit(None).cast("float"))
    df = df.withColumn("VesselType", F.lit("70"))
    out = identities(df)
    got = {(r["MMSI"], r["VesselName"]): r for r in out.collect()}
    assert len(got) == 3
    r = got[(1, "N")]
    assert r["LastKnownDate"] == ts("2024-01-01T00:00:02")
    assert (r["LastLAT"], r["LastLON"], r["TransceiverClass"], r["Draft"]) == (1.0, 7.0, True, None)
    assert [p["LAT"] for p in r["Positions"]] == [2.0, 1.0, None]
    write_identities(out, str(tmp_path / "ships"))
    back = spark.read.parquet(str(tmp_path / "ships"))
    assert {r["mmsi_prefix"] for r in back.select("mmsi_prefix").distinct().collect()} == {1, None}
    daily = identities(df, daily=True)
    assert daily.where("MMSI = 1 and VesselName = 'N'").count() == 2
    slim = identities(df, positions=False)
    assert "Positions" not in slim.columns and {r["N"] for r in slim.collect()} == {3, 1}


LINES = [
    "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,IMO,CallSign,VesselType,Status,Length,Width,Draft,Cargo,TransceiverClass",
    "367,2024-01-01T00:00:01,29.5,-90.1,1.5,NaN,1e2,NAME,IMO9348651,WDK,70,0,100,20,5.5,70,B",
    "bad,2024-01-01 10:00:00+05:30, 1.5,1.5f,,inf,-inf,\"A, B\",123,,,,,,,,A",
    "5.0,2024-13-40T00:00:00,.5,5.,,,,x,IMO,,,,,,,,",
    "+7,  2024-01-01T00:00:01.250+05  ,,,,,,,IMOIMO1,,,,,,,,b,",
    "1,2,3",
    "",
]


def test_csv_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("\n".join(LINES) + "\n")
    (tmp_path / "in/b.txt").write_text("9" + "," * 16)
    rows = ingest(spark, str(tmp_path / "in")).collect()
    assert len(rows) == 4
    one, two, three, four = rows
    assert (one["MMSI"], one["IMO"], one["TransceiverClass"], one["VesselName"]) == (367, 9348651, True, "NAME")
    assert one["BaseDateTime"] == ts("2024-01-01T00:00:01") and one["COG"] != one["COG"] and one["Heading"] == 100
    assert two["MMSI"] is None and two["BaseDateTime"] == ts("2024-01-01T04:30:00")
    assert (two["LAT"], two["LON"], two["COG"], two["Heading"], two["VesselName"]) == (None, None, float("inf"), float("-inf"), "A, B")
    assert two["IMO"] == 123 and two["CallSign"] is None and two["TransceiverClass"] is False
    assert (three["MMSI"], three["BaseDateTime"], three["LAT"], three["LON"], three["IMO"], three["TransceiverClass"]) == (None, None, 0.5, 5.0, None, None)
    assert four["MMSI"] == 7 and four["IMO"] is None and four["BaseDateTime"] == ts("2024-01-01T00:00:01")
    skipped = skipped_lines(read_lines(spark, str(tmp_path / "in"))).collect()
    assert [r["skipped"] for r in skipped] == [3]
    assert ingest(spark, str(tmp_path / "in"), max_rows=2).count() == 2


def test_skipped_lines_are_cut_before_they_are_gathered(spark):
    lines = [(f"{k:03}" + "x" * 300, f) for k in range(40) for f in ("a", "b", None)] + [("000" + "x" * 300, "a"), ("," * 16, "a"), (None, "a")]
    out = skipped_lines(spark.createDataFrame(lines, "value string, file string"))
    want = [f"{k:03}" + "x" * 197 for k in range(5)]
    assert {r["file"]: (r["skipped"], r["samples"]) for r in out.collect()} == {"a": (41, want), "b": (40, want), None: (40, want)}
    assert "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()


def test_streaming_ingest_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    paths = [str(tmp_path / x) for x in ("in", "out", "state")]
    for n in (1, 2, 2):
        if n == 1 or not (tmp_path / "in/2.csv").exists():
            (tmp_path / f"in/{n}.csv").write_text("\n".join(LINES[:2]) + "\n")
        q = ingest_new(spark, *paths)
        q.awaitTermination()
    assert spark.read.parquet(paths[1]).count() == 2


def test_predicates_and_counts(spark):
    df = spark.createDataFrame([(1, "a", ts("2024-01-01")), (2, None, ts("2024-01-02")), (3, "a", None)], "x int, t string, BaseDateTime timestamp_ntz")
    q = TrackQuery()
    assert q.between("x", 1, 3, low_closed=False, high_closed=False).run(df).first()["n"] == 1
    assert q.between("x", None, 2).run(df).first()["n"] == 2
    assert q.during("2024-01-01", "2024-01-02").run(df).first()["n"] == 1
    assert {r["t"]: r["n"] for r in group_counts(df, "t").collect()} == {"a": 2}
    assert day_counts(df).count() == 2
    assert semi_join(df, df.where("x = 2"), "x").count() == 1
    assert any_of([]) is None and df.where(all_of([None])).count() == 3
    with pytest.raises(ValueError):
        q.closing("no").run(df)


def test_reports(spark):
    t = [reporting.Timing("q", "a", 1, [1.0, 3.0]), reporting.Timing("q", "b", 1, [1.0]), reporting.Timing("r", "a", None, status="timeout")]
    assert t[0].median == 2 and "| q | 1 |" in reporting.markdown(t) and json.loads(reporting.as_json(t[:2]))[0]["mean"] == 2
    with pytest.raises(AssertionError):
        reporting.check_consistency([*t, reporting.Timing("q", "c", 2, [1.0])])
    assert reporting.speedup(2, 1) == 2 and round(reporting.geometric_mean([1, 4]), 9) == 2
    assert (reporting.size_label(1_000_000), reporting.size_label(500_000), reporting.byte_label(262144)) == ("1M", "500K", "256KB")
    sweep = spark.createDataFrame([("1M", "64K", 1.0), ("1M", "64K", 4.0), ("5M", "64K", 9.0)], "rows string, page string, seconds double")
    assert reporting.best_cell(sweep, ["rows", "page"]).first()["rows"] == "1M"
    assert reporting.sweep_table(sweep, "rows", "page").count() == 2
    ran = reporting.timed(spark, "q", "a", lambda: spark.range(5).count(), repeats=1)
    assert ran.count == 5 and ran.status == "ok"
    assert reporting.timed(spark, "q", "a", lambda: 1 / 0).status.startswith("error")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "csv").mkdir()
    lines = [LINES[0], "1,2", *[f"{k % 7},2024-10-{10 + k % 20}T0{k % 9}:00:00,{25 + k % 9},-9{k % 9}.5,1,2,3,NAME {k % 7},IMO{k},WDK{k % 7},70,0,1,2,3,4,A" for k in range(300)]]
    (tmp_path / "csv/a.csv").write_text("\n".join(lines) + "\n")
    source, folder = str(tmp_path / "source"), str(tmp_path / "layouts")
    cli.main(["--set", "spark.sql.shuffle.partitions=3", "ingest", str(tmp_path / "csv"), source, "--compression-level", "3"])
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert spark.read.parquet(source).count() == 300 and "|      2|" in capsys.readouterr().out
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        cli.main(["ingest", str(tmp_path / "csv"), source])
    chosen = ["--only", "monolithic", "--only", "partitioned_curve_bloom"]
    cli.main(["layouts", source, folder, *chosen, "--bloom", "CallSign", "--bloom-ndv-of", "CallSign=500", "--smart-row-groups"])
    _, layout = read_layout(spark, f"{folder}/partitioned_curve_bloom")
    assert layout.blooms == ("MMSI", "IMO", "CallSign") and layout.row_group_rows == 3 and layout.bloom_ndv_by_column == {"CallSign": 500}
    cli.main(["--quiet", "queries", folder, *chosen, "--repeats", "1", "--warmups", "0", "--json", str(tmp_path / "r.json"), "--markdown", str(tmp_path / "r.md")])
    timings = json.loads((tmp_path / "r.json").read_text())
    assert len(timings) == 62 and {t["status"] for t in timings} == {"ok"} and "| count all | 300 |" in (tmp_path / "r.md").read_text()
    capsys.readouterr()
    cli.main(["sql", folder, "SELECT count(*) AS n FROM partitioned_curve_bloom JOIN monolithic USING (MMSI, BaseDateTime, IMO)", *chosen])
    cli.main(["plans", folder, *chosen])
    out = capsys.readouterr().out
    assert "|300|" in out and "partitioned_curve_bloom, single day: " in out and "implied: days of the time range" in out
    cli.main(["identities", source, str(tmp_path / "daily")])
    cli.main(["identities", source, str(tmp_path / "whole"), "--whole"])
    daily, whole = (spark.read.parquet(str(tmp_path / n)) for n in ("daily", "whole"))
    assert "Day" in daily.columns and "Day" not in whole.columns
    assert all(f.agg(F.sum(F.size("Positions"))).first()[0] == 300 for f in (daily, whole))
