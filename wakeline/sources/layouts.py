"""Physical layouts of a position table: partitioning by day, bloom filters, curve order.

A layout is metadata; queries do not change with it.  What pruning needs to know (curve
and bounds) is kept beside the data in ``<path>.layout.json``, read and written through
Spark's own file system, so any store works.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.curve import CURVES, key_column
from wakeline.functions.scalars import day_columns

log = logging.getLogger(__name__)

DAY = ("year", "month", "day")
KEY = "curve_key"
SIDECAR = ".layout.json"
DEFAULT_BLOOMS = ("MMSI", "IMO")
PAGE_ROWS, PAGE_BYTES = 20_000, 1 << 20  # the Parquet writer's own limits of a page


@dataclass(frozen=True)
class Layout:
    name: str
    partitioned: bool = True
    curve: str | None = None
    blooms: tuple[str, ...] = ()
    row_group_rows: int = 1_000_000
    page_bytes: int = 0
    compression_level: int = 6
    bloom_fpp: float = 0.01
    bloom_ndv: int = 1_000_000
    bloom_ndv_by_column: dict = field(default_factory=dict)
    time_column: str = "BaseDateTime"
    axes: tuple[str, ...] = ("LAT", "LON")
    bounds: tuple[tuple[float, float], ...] | None = None  # of the axes; taken from the data if None

    def writer_options(self) -> dict[str, str]:
        """Parquet options: row group rows, pages, compression, bloom filters.

        Columns with a bloom filter are written without dictionary: the writer leaves the filter out of a
        chunk that is all dictionary.
        """
        out = {
            "compression": "zstd",
            "parquet.compression.codec.zstd.level": str(self.compression_level),
            "parquet.block.row.count.limit": str(self.row_group_rows),
        }
        if self.page_bytes:
            out["parquet.page.size"] = str(self.page_bytes)
        for c in self.blooms:
            out |= {
                f"parquet.bloom.filter.enabled#{c}": "true",
                f"parquet.bloom.filter.expected.ndv#{c}": str(self.bloom_ndv_by_column.get(c, self.bloom_ndv)),
                f"parquet.bloom.filter.fpp#{c}": str(self.bloom_fpp),
                f"parquet.enable.dictionary#{c}": "false",
            }
        return out


    def reader_options(self) -> dict[str, str]:
        """Page pruning off where a column's row group is one page of numbers: its statistics say as much, and each look at a page index costs reads of its own, many times a small row group's bytes."""
        small = self.row_group_rows <= PAGE_ROWS and 8 * self.row_group_rows <= (self.page_bytes or PAGE_BYTES)
        return {"parquet.filter.columnindex.enabled": "false"} if small else {}

    @property
    def description(self) -> str:
        """What a scan of the layout can skip by."""
        parts = ["row group statistics"]
        if self.partitioned:
            parts.append("day partitions")
        if self.blooms:
            parts.append("bloom filters of " + ", ".join(self.blooms))
        if self.curve:
            parts.append(f"{self.curve} curve intervals")
        return " + ".join(parts)


#: The typed table that layouts are made of.
SOURCE = Layout("source", partitioned=False)

#: The five layouts that queries are compared on.
LAYOUTS = {
    x.name: x
    for x in (
        Layout("monolithic", partitioned=False),
        Layout("partitioned"),
        Layout("partitioned_bloom", blooms=DEFAULT_BLOOMS),
        Layout("partitioned_curve", curve="hilbert2d"),
        Layout("partitioned_curve_bloom", curve="hilbert2d", blooms=DEFAULT_BLOOMS),
    )
}


def bloom_columns(*more: str) -> tuple[str, ...]:
    """The default bloom columns and others, each once."""
    return tuple(dict.fromkeys([*DEFAULT_BLOOMS, *more]))


def parse_ndv(text: str) -> tuple[str, int]:
    """``COLUMN=NDV``."""
    column, _, n = text.partition("=")
    if not column or not n.isdigit():
        raise ValueError(f"not COLUMN=NDV: {text!r}")
    return column, int(n)


def bounds_row(df: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """One row with ``<axis>_low`` and ``<axis>_high`` of each axis, NaN left out."""

    def number(a: str):
        kind = df.schema[a].dataType.simpleString()
        c = F.unix_micros(F.col(a).cast("timestamp")).cast("double") if kind.startswith("timestamp") else F.col(a).cast("double")
        return F.when(~F.isnan(c), c)

    return df.agg(*[f(number(a)).alias(f"{a}_{k}") for a in axes for k, f in (("low", F.min), ("high", F.max))])


def axis_bounds(df: DataFrame, axes: tuple[str, ...]) -> tuple[tuple[float, float], ...]:
    """Least and greatest value of each axis, NaN left out; (0, 0) without values."""
    row = bounds_row(df, axes).first()
    return tuple((row[f"{a}_low"] or 0.0, row[f"{a}_high"] or 0.0) for a in axes)


def footers(spark: SparkSession) -> SparkSession:
    """A session whose Parquet reads answer unfiltered counts and bounds of numbers and dates from the files' footers.

    Spark pushes such aggregates to its second reader only; everything else is as in the given session. Files
    whose footers lack a column's statistics (those of columns with NaN do) are an error in it.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in spark.conf.get("spark.sql.sources.useV1SourceList").split(",") if x != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def footer_bounds(spark: SparkSession, path: str, axes: tuple[str, ...]) -> DataFrame:
    """``bounds_row`` of a table of files for number columns without NaN, from the footers alone."""
    return footers(spark).read.parquet(path).agg(*[f(a).alias(f"{a}_{k}") for a in axes for k, f in (("low", F.min), ("high", F.max))])


def partition_keys(df: DataFrame, time_column: str = "BaseDateTime") -> DataFrame:
    """The distinct days of a table as partition columns, in order."""
    return df.select(*[c.alias(n) for n, c in day_columns(F.col(time_column)).items()]).distinct().orderBy(*DAY)


def smart_row_group_rows(df: DataFrame, most: int, time_column: str = "BaseDateTime", per_day: int = 5) -> int:
    """Row group size that gives an average day ``per_day`` groups, ``most`` rows at most."""
    n, days = df.agg(F.count(F.lit(1)), F.count_distinct(F.to_date(time_column))).first()
    return max(1, min(most, n // max(days, 1) // per_day))


def arranged(df: DataFrame, layout: Layout) -> DataFrame:
    """The table with partition and curve columns, dealt out and sorted for the layout's files.

    Rows are dealt by ranges of day and order, so a day of any size spreads over tasks, each of
    which has a range of its keys or times of its own, and small days share one.
    """
    out, order = df, []
    if layout.curve:
        curve = CURVES[layout.curve]
        axes = [F.unix_micros(F.col(a).cast("timestamp")).cast("double") if df.schema[a].dataType.simpleString().startswith("timestamp") else F.col(a) for a in layout.axes]
        out = out.withColumn(KEY, key_column(curve, axes, list(layout.bounds)))
        order = [KEY]
    if layout.partitioned:
        out = out.withColumns(day_columns(F.col(layout.time_column)))
        order = [*DAY, *order]
    if not order:
        return out
    return out.repartitionByRange(*order, layout.time_column).sortWithinPartitions(*order, layout.time_column)


def write_layout(df: DataFrame, path: str, layout: Layout, overwrite: bool = False, smart: bool = False) -> Layout:
    """Write a table in a layout; returns the layout as written, with its bounds and row group size."""
    start = time.perf_counter()
    log.info("%s: writing to %s (%s)", layout.name, path, layout.description)
    if smart:
        layout = replace(layout, row_group_rows=smart_row_group_rows(df, layout.row_group_rows, layout.time_column))
    if layout.curve and layout.bounds is None:
        layout = replace(layout, bounds=axis_bounds(df, layout.axes))
    writer = arranged(df, layout).write.mode("overwrite" if overwrite else "errorifexists").options(**layout.writer_options())
    if layout.partitioned:
        writer = writer.partitionBy(*DAY)
    writer.parquet(path)
    write_text(df.sparkSession, f"{path}{SIDECAR}", json.dumps(asdict(layout)))
    log.info("%s: written in %.1f s", layout.name, time.perf_counter() - start)
    return layout


def write_layouts(df: DataFrame, folder: str, layouts: list[Layout], overwrite: bool = False, smart: bool = False) -> dict[str, Layout]:
    """Write several layouts of one typed table, which each of them scans."""
    return {x.name: write_layout(df, f"{folder}/{x.name}", x, overwrite, smart) for x in layouts}


def read_layout(spark: SparkSession, path: str, view: str | None = None) -> tuple[DataFrame, Layout]:
    """A layout's table and its metadata, also as a temporary ``view`` for SQL; a curve column written by others as unsigned is read as long."""
    held = json.loads(read_text(spark, f"{path}{SIDECAR}"))
    layout = Layout(**held | {k: tuple(held[k]) for k in ("blooms", "axes")} | {"bounds": tuple(map(tuple, held["bounds"])) if held["bounds"] else None})
    df = spark.read.options(**layout.reader_options()).parquet(path)
    if layout.curve and df.schema[KEY].dataType.simpleString() != "bigint":
        df = df.withColumn(KEY, F.col(KEY).cast("long"))
    if view:
        df.createOrReplaceTempView(view)
    return df, layout


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def scratch(spark: SparkSession, base: str) -> str:
    """A new folder in ``base`` that goes when the session's process ends."""
    path = f"{base}/wakeline-{uuid.uuid4().hex}"
    fs, at = _file(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())
