"""Registered queries of the track-analytics operators and their DuckDB SQL.

The driver's tables hold no vessel reports, so each operator runs over the columns there
that are like its own: ``events`` for identities and times, ``lineitem`` for boxes, names from ``part``
and ``customer``.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.functions import scalars
from wakeline.functions.curve import CURVES, key_column, key_sql, key_sql_3d, scale
from wakeline.operators.identities import identities, write_identities
from wakeline.operators.predicates import TrackQuery, day_counts, group_counts, semi_join
from wakeline.plans.planner import plan
from wakeline.plans.metrics import scan_metrics
from wakeline.reporting import sweep_table
from wakeline.schema import RAW_COLUMNS
from wakeline.sources.csv_ingest import ingest, raw_rows, read_lines, skipped_lines, typed
from wakeline.sources.layouts import Layout, bounds_row, footer_bounds, footers, partition_keys, read_layout, scratch, smart_row_group_rows, write_layout

Q = TrackQuery(time_column="ts")
SHIP = TrackQuery(time_column="l_shipdate")
_DATES = "'1997-01-01'", "'1997-02-01'"
_BOX = "l_quantity BETWEEN 10 AND 20 AND l_extendedprice BETWEEN 20000 AND 40000"

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "identity_rollup"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _track(name: str, table: str, query: TrackQuery, sql: str, *columns: str) -> None:
    """Register a declarative query; ``columns`` are those of a rows query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query.run(_table(spark, sf_dir, table))
        return out.select(*columns) if columns else out

    QUERIES[name], ORACLE_SQL[name] = run, sql


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def box(query: TrackQuery) -> TrackQuery:
    return query.box((10, 20), (20000, 40000), "l_quantity", "l_extendedprice")


# Point lookups, names, times, boxes and their combinations.
_EV = "event_id, ts, user_id, event_type, value"
_E = tuple(_EV.split(", "))
_track("point_eq", "events", Q.one_of("user_id", 42).closing("rows"), f"SELECT {_EV} FROM events WHERE user_id = 42", *_E)
_track("point_in", "events", Q.one_of("user_id", 3, 42, 77, 101, 149), "SELECT count(*) AS n FROM events WHERE user_id IN (3, 42, 77, 101, 149)")
_track("string_eq", "customer", Q.one_of("c_mktsegment", "MACHINERY"), "SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY'")
_track(
    "string_in", "customer", Q.one_of("c_mktsegment", "MACHINERY", "FURNITURE"), "SELECT count(*) AS n FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE')"
)
_track("string_prefix", "part", Q.prefix("p_name", "red"), "SELECT count(*) AS n FROM part WHERE starts_with(p_name, 'red')")
_track("string_substring", "part", Q.substring("p_name", "widget"), "SELECT count(*) AS n FROM part WHERE contains(p_name, 'widget')")
for _n, _a, _b in (("day", "2024-01-20", "2024-01-21"), ("week", "2024-01-14", "2024-01-21"), ("month", "2024-01-01", "2024-02-01"), ("hour", "2024-01-20 04", "2024-01-20 05")):
    _sql = [f"TIMESTAMP '{t}{':00:00' if ' ' in t else ' 00:00:00'}'" for t in (_a, _b)]
    _track(f"time_{_n}", "events", Q.during(_a, _b), f"SELECT count(*) AS n FROM events WHERE ts >= {_sql[0]} AND ts < {_sql[1]}")
_track("bbox", "lineitem", box(SHIP), f"SELECT count(*) AS n FROM lineitem WHERE {_BOX}")
_track("open_range", "lineitem", SHIP.between("l_quantity", 10, None, low_closed=False), "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10")
_track(
    "bbox_time",
    "lineitem",
    box(SHIP).during("1997-01-01", "1997-02-01"),
    f"SELECT count(*) AS n FROM lineitem WHERE {_BOX} AND l_shipdate >= {_DATES[0]} AND l_shipdate < {_DATES[1]}",
)
_track("type_bbox", "lineitem", box(SHIP).one_of("l_returnflag", "R"), f"SELECT count(*) AS n FROM lineitem WHERE {_BOX} AND l_returnflag = 'R'")
_track(
    "id_time",
    "events",
    Q.one_of("user_id", 42).during("2024-01-14", "2024-01-21").closing("rows"),
    f"SELECT {_EV} FROM events WHERE user_id = 42 AND ts >= '2024-01-14' AND ts < '2024-01-21'",
    *_E,
)
_track("count_groups", "events", Q.closing("groups", "event_type"), "SELECT count(DISTINCT event_type) AS n FROM events")
_track("count_days", "events", Q.closing("days"), "SELECT count(DISTINCT ts::DATE) AS n FROM events")
_track("distinct_ids", "events", Q.closing("distinct", "user_id"), "SELECT count(DISTINCT user_id) AS n FROM events")


@_register("SELECT count(*) AS n FROM events")
def count_all(spark, sf_dir):
    """An unfiltered count, from the files' footers."""
    return Q.run(_table(footers(spark), sf_dir, "events"))


@_register("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def group_type(spark, sf_dir):
    return group_counts(_table(spark, sf_dir, "events"), "event_type")


@_register("SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def count_by_day(spark, sf_dir):
    return day_counts(_table(spark, sf_dir, "events"), "ts")


@_register("SELECT count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def id_list(spark, sf_dir):
    ids = _table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    return semi_join(_table(spark, sf_dir, "lineitem"), ids, "l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@_register("SELECT DISTINCT year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day FROM events")
def day_partitions(spark, sf_dir):
    return partition_keys(_table(spark, sf_dir, "events"), "ts")


@_register("SELECT min(l_quantity) AS low_a, max(l_quantity) AS high_a, min(l_extendedprice) AS low_b, max(l_extendedprice) AS high_b FROM lineitem")
def bounds(spark, sf_dir):
    """Bounds from the files' footers."""
    row = footer_bounds(spark, f"{sf_dir}/lineitem.parquet", ("l_quantity", "l_extendedprice"))
    return row.select(*[F.col(f"{c}_{k}").alias(f"{k}_{n}") for n, c in (("a", "l_quantity"), ("b", "l_extendedprice")) for k in ("low", "high")])


@_register("SELECT c_custkey, TRY_CAST(substr(c_custkey::VARCHAR, 1, 1) AS INT) AS digit FROM customer")
def first_digit(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", scalars.first_digit(F.col("c_custkey")).alias("digit"))


@_register(
    """
SELECT user_id, event_type, max(ts) AS last_ts, count(*) AS n,
       arg_max(value, (ts, event_id)) AS last_value, arg_max(event_id, (ts, event_id)) AS last_event
FROM events GROUP BY user_id, event_type"""
)
def identity_rollup(spark, sf_dir):
    """Last known values of each identity, in one aggregation."""
    rolled = identities(_table(spark, sf_dir, "events"), ("user_id", "event_type"), "ts", ("value", "event_id"), ("ts", "event_id"), positions=False)
    return rolled.select("user_id", "event_type", F.col("LastKnownDate").alias("last_ts"), F.col("N").alias("n"), F.col("value").alias("last_value"), F.col("event_id").alias("last_event"))


@_register(
    """
SELECT user_id, event_type, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, value, event_id) - 1)::INT AS pos, ts, value, event_id FROM events"""
)
def identity_positions(spark, sf_dir):
    """The ordered track of each identity, one row per position; rows in between hold a day's positions at most."""
    events, by = _table(spark, sf_dir, "events"), ("user_id", "event_type", "Day")
    days = identities(events, ("user_id", "event_type"), "ts", (), ("ts", "value", "event_id"), daily=True)
    # The positions of earlier days, counted apart so that only counts of an identity's days meet in one task; the day of null times is the last.
    counts = events.groupBy("user_id", "event_type", F.to_date("ts").alias("Day")).agg(F.count(F.lit(1)).alias("n"))
    until = Window.partitionBy("user_id", "event_type").orderBy(F.col("Day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select(*[F.col(c).alias(f"of_{c}") for c in by], F.coalesce(F.sum("n").over(until), F.lit(0)).alias("earlier"))
    placed = days.join(earlier, [days[c].eqNullSafe(earlier[f"of_{c}"]) for c in by])
    rows = placed.select("user_id", "event_type", "earlier", F.posexplode("Positions").alias("pos", "p"))
    return rows.select("user_id", "event_type", (F.col("pos") + F.col("earlier")).cast("int").alias("pos"), "p.*")


_ROLLUP_DAYS = """
SELECT user_id, event_type, ts::DATE AS "Day", max(ts) AS "LastKnownDate", count(*) AS positions,
       arg_max(value, (ts, value, event_id)) AS value
FROM events GROUP BY 1, 2, 3"""


@_register(_ROLLUP_DAYS)
def identity_days(spark, sf_dir):
    """The roll-up by day: no row grows beyond a day's positions."""
    rolled = identities(_table(spark, sf_dir, "events"), ("user_id", "event_type"), "ts", ("value",), ("ts", "event_id"), daily=True)
    return rolled.select("user_id", "event_type", "Day", "LastKnownDate", F.size("Positions").cast("long").alias("positions"), "value")


_BOUNDS = ((1.0, 50.0), (0.0, 120000.0))
_X, _Y = (f"floor(least(greatest(({c} - {lo}::DOUBLE) / {hi - lo}::DOUBLE, 0), 1) * 2147483647 + 0.5)" for c, (lo, hi) in zip(("l_quantity", "l_extendedprice"), _BOUNDS, strict=True))


def _curve(name: str, corrected: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _table(spark, sf_dir, "lineitem")
        key = key_column(CURVES[name], [F.col("l_quantity"), F.col("l_extendedprice")], list(_BOUNDS))
        return t.select("l_orderkey", "l_linenumber", "l_partkey", key.alias("curve_key"))

    QUERIES[f"curve_{name}"] = run
    ORACLE_SQL[f"curve_{name}"] = key_sql(_X, _Y, "lineitem", "l_orderkey, l_linenumber, l_partkey", corrected=corrected)


_curve("compat2d", False)
_curve("hilbert2d", True)

_AXES_3D = (("l_quantity", 1.0, 50.0), ("l_extendedprice", 0.0, 120000.0), ("l_discount", 0.0, 0.1))
_SCALED_3D = tuple(f"floor(least(greatest(({c} - {lo}::DOUBLE) / {hi - lo}::DOUBLE, 0), 1) * 2097151 + 0.5)" for c, lo, hi in _AXES_3D)


@_register(key_sql_3d(_SCALED_3D, "lineitem", "l_orderkey, l_linenumber, l_partkey"))
def curve_hilbert3d(spark, sf_dir):
    key = key_column(CURVES["hilbert3d"], [F.col(c) for c, _, _ in _AXES_3D], [(lo, hi) for _, lo, hi in _AXES_3D])
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("curve_key"))


@_register(f"SELECT l_orderkey, l_linenumber, l_partkey, ({_X})::BIGINT AS x, ({_Y})::BIGINT AS y FROM lineitem")
def curve_scale(spark, sf_dir):
    x, y = (scale(F.col(c), lo, hi, CURVES["hilbert2d"].top) for c, (lo, hi) in zip(("l_quantity", "l_extendedprice"), _BOUNDS, strict=True))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x"), y.alias("y"))


def _scratch(spark: SparkSession) -> str:
    """A folder for a layout that a query writes and reads: in the shared folder, or a temporary one in a session within one process (tests).

    It has to outlive the query, whose result is read from it, and goes with the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return scratch(spark, base or tempfile.gettempdir()) + "/table"


def _layout(name: str, table: str, layout: Layout, query: TrackQuery, sql: str) -> None:
    """Register a query that writes a table in a layout and runs over it with implied predicates."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _scratch(spark)
        write_layout(_table(spark, sf_dir, table), path, layout)
        df, held = read_layout(spark, path)
        return plan(df, query, held)

    QUERIES[name], ORACLE_SQL[name] = run, sql


_AXES = {"partitioned": False, "time_column": "l_shipdate", "axes": ("l_quantity", "l_extendedprice")}
_IDS = (3, 42, 77)
_layout(
    "layout_days",
    "events",
    Layout("days", blooms=("user_id",), bloom_ndv=20_000, time_column="ts"),
    Q.one_of("user_id", *_IDS).during("2024-01-14", "2024-01-21"),
    f"SELECT count(*) AS n FROM events WHERE user_id IN {_IDS} AND ts >= '2024-01-14' AND ts < '2024-01-21'",
)
for _c in ("hilbert2d", "compat2d"):
    _layout(f"layout_{_c}", "lineitem", Layout(_c, curve=_c, **_AXES), box(SHIP), f"SELECT count(*) AS n FROM lineitem WHERE {_BOX}")
_layout(
    "layout_hilbert3d",
    "events",
    Layout("track", curve="hilbert3d", time_column="ts", axes=("ts", "user_id", "value")),
    Q.between("user_id", 10, 60).between("value", 5, 20).during("2024-01-14", "2024-01-21"),
    "SELECT count(*) AS n FROM events WHERE user_id BETWEEN 10 AND 60 AND value BETWEEN 5 AND 20 AND ts >= '2024-01-14' AND ts < '2024-01-21'",
)


@_register(
    """
SELECT event_id AS "MMSI", date_trunc('second', ts) AS "BaseDateTime", (user_id / 4.0)::FLOAT AS "LAT", event_type AS "VesselName",
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS "IMO", event_type = 'click' AS "TransceiverClass" FROM events"""
)
def csv_ingest(spark, sf_dir):
    """Position lines made of events, through the line filter and the typed projection."""
    e = _table(spark, sf_dir, "events")
    text = F.concat_ws(
        ",",
        F.col("event_id").cast("string"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        (F.col("user_id") / 4).cast("string"),
        *[F.lit("")] * 4,
        F.col("event_type"),
        F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("IMO"), F.col("user_id").cast("string"))),
        *[F.lit("")] * 7,
        F.when(F.col("event_type") == "click", F.lit("B")).otherwise(F.lit("A")),
    )
    noise = spark.createDataFrame([("MMSI,BaseDateTime,LAT",), ("1,2,3",)], "value string")
    lines = e.select(text.alias("value")).unionByName(noise)
    return typed(raw_rows(lines)).select("MMSI", "BaseDateTime", "LAT", "VesselName", "IMO", "TransceiverClass")


@_register(
    """
SELECT l_linenumber, round(exp(avg(ln(l_extendedprice)) FILTER (l_returnflag = 'A')), 4) AS "A",
       round(exp(avg(ln(l_extendedprice)) FILTER (l_returnflag = 'N')), 4) AS "N",
       round(exp(avg(ln(l_extendedprice)) FILTER (l_returnflag = 'R')), 4) AS "R" FROM lineitem GROUP BY 1"""
)
def geometric_means(spark, sf_dir):
    """A sweep's heat map: geometric means by two parameters."""
    table = sweep_table(_table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", "l_extendedprice")
    return table.select("l_linenumber", *[F.round(c, 4).alias(c) for c in ("A", "N", "R")])


@_register(
    """
SELECT event_type, user_id, n, (row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id))::INT AS rank
FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 5"""
)
def top_ranked(spark, sf_dir):
    """The five most active of each group, as a report ranks layouts."""
    n = _table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return n.withColumn("rank", rank).where("rank <= 5")


@_register("SELECT min(l_quantity) AS low_a, max(l_quantity) AS high_a, min(epoch_us(l_shipdate))::DOUBLE AS low_b, max(epoch_us(l_shipdate))::DOUBLE AS high_b FROM lineitem")
def layout_bounds(spark, sf_dir):
    """Bounds as layouts keep them, of a number and a time."""
    row = bounds_row(_table(spark, sf_dir, "lineitem"), ("l_quantity", "l_shipdate"))
    return row.select(*[F.col(f"{a}_{k}").alias(f"{k}_{n}") for n, a in (("a", "l_quantity"), ("b", "l_shipdate")) for k in ("low", "high")])


@_register(f"SELECT count(*) AS n, true AS spares_rows FROM lineitem WHERE {_BOX}")
def layout_skipping(spark, sf_dir):
    """A box over a layout in curve order, and whether layout and curve intervals spare more than half of the rows that the box alone reads of the table as it came."""
    path, table = _scratch(spark), _table(spark, sf_dir, "lineitem")
    write_layout(table, path, Layout("skipping", curve="hilbert2d", row_group_rows=500, page_bytes=4096, **_AXES))
    df, held = read_layout(spark, path)
    with_curve, alone = (scan_metrics(q)["rows"] for q in (plan(df, box(SHIP), held), box(SHIP).run(table)))
    return plan(df, box(SHIP), held).withColumn("spares_rows", F.lit(2 * with_curve < alone))


@_register("SELECT greatest(1, least(1000, count(*) // count(DISTINCT ts::DATE) // 5))::INT AS row_group_rows FROM events")
def smart_row_groups(spark, sf_dir):
    """Rows of a row group that give an average day five groups."""
    n = smart_row_group_rows(_table(spark, sf_dir, "events"), 1000, "ts")
    return spark.range(1).select(F.lit(n).cast("int").alias("row_group_rows"))


@_register(
    """
SELECT user_id AS "MMSI", event_type AS "VesselName", TRY_CAST(substr(user_id::VARCHAR, 1, 1) AS INT) AS mmsi_prefix,
       max(ts) AS "LastKnownDate", count(*) AS positions FROM events GROUP BY 1, 2"""
)
def identity_sink(spark, sf_dir):
    """The roll-up written by the first digit of the identity, read again."""
    path = _scratch(spark)
    e = _table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "MMSI", "event_type": "VesselName"})
    write_identities(identities(e, ("MMSI", "VesselName"), "ts", ("value",), ("ts", "event_id")), path)
    return spark.read.parquet(path).select("MMSI", "VesselName", F.col("mmsi_prefix").cast("int"), "LastKnownDate", F.size("Positions").cast("long").alias("positions"))


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of CSV files of position reports made of events, with a header, a short line and one of too many fields."""
    path = _scratch(spark)
    e = _table(spark, sf_dir, "events")
    known = {
        "MMSI": F.col("event_id"), "BaseDateTime": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "LAT": F.col("user_id") / 4, "VesselName": F.concat(F.col("event_type"), F.lit(", A")),
        "IMO": F.concat(F.lit("IMO"), F.col("user_id")), "TransceiverClass": F.when(F.col("event_type") == "click", "B").otherwise("A"),
    }
    fields = [known.get(c, F.lit(None)).cast("string").alias(c) for c in RAW_COLUMNS]
    e.select(*fields).write.option("header", "true").option("emptyValue", "").csv(path)
    noise = spark.createDataFrame([("1", "2"), tuple("abcdefghijklmnopqrst")[:2]], "a string, b string")
    noise.write.mode("append").csv(path)
    return path


@_register(
    """
SELECT event_id AS "MMSI", date_trunc('second', ts) AS "BaseDateTime", (user_id / 4.0)::FLOAT AS "LAT", event_type || ', A' AS "VesselName",
       user_id AS "IMO", event_type = 'click' AS "TransceiverClass" FROM events"""
)
def csv_folder(spark, sf_dir):
    """A folder of CSV files, quoted commas among them, through line filter and typed projection."""
    return ingest(spark, _csv_folder(spark, sf_dir)).select("MMSI", "BaseDateTime", "LAT", "VesselName", "IMO", "TransceiverClass")


@_register("SELECT * FROM (VALUES ('1,2'), ('a,b')) AS t(line)")
def csv_skipped(spark, sf_dir):
    """Lines of a CSV folder that the filter skips, headers left out."""
    lines = skipped_lines(read_lines(spark, _csv_folder(spark, sf_dir)))
    return lines.select(F.explode("samples").alias("line")).where(~F.col("line").startswith("MMSI,"))


@_register("SELECT least(100, count(*)) AS n FROM events")
def csv_capped(spark, sf_dir):
    """At most 100 rows of a CSV folder."""
    return ingest(spark, _csv_folder(spark, sf_dir), max_rows=100).agg(F.count(F.lit(1)).alias("n"))
