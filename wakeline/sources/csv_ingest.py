"""CSV position reports: line filter, raw columns, typed projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.functions import scalars
from wakeline.schema import FLOATS, RAW, RAW_COLUMNS, STRINGS

HEADER = "MMSI,"
COMMAS = (16, 17)  # 17: a quoted comma or a trailing one


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines (value, file) of the folder's CSV files."""
    return spark.read.option("pathGlobFilter", "*.csv").text(folder).withColumn("file", F.input_file_name())


def well_formed(line: Column) -> Column:
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    return ~line.startswith(HEADER) & commas.isin(*COMMAS)


def raw_rows(lines: DataFrame) -> DataFrame:
    """Well-formed lines as raw text columns."""
    ok = lines.where(well_formed(F.col("value")))
    return ok.select(F.from_csv("value", RAW.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def skipped_lines(lines: DataFrame) -> DataFrame:
    """Per file: lines skipped (headers too) and the first five of them."""
    bad = lines.where(~well_formed(F.col("value")))
    counts = bad.groupBy("file").agg(F.count("*").alias("skipped"))
    distinct = bad.select(F.col("file").alias("of"), F.substring("value", 1, 200).alias("line")).distinct()
    # The limit on the row number drops lines within each task before they are sent on.
    rank = F.row_number().over(Window.partitionBy("of").orderBy("line"))
    first = distinct.withColumn("rank", rank).where("rank <= 5").groupBy("of").agg(F.array_sort(F.collect_list("line")).alias("samples"))
    return counts.join(first, F.col("file").eqNullSafe(F.col("of"))).select("file", "skipped", "samples")


def typed(raw: DataFrame) -> DataFrame:
    """Raw text columns in their types; what does not parse is null."""

    def column(name: str):
        c = scalars.empty_to_null(F.col(name))
        if name == "MMSI":
            c = scalars.parse_long(c)
        elif name == "IMO":
            c = scalars.parse_imo(c)
        elif name in FLOATS:
            c = scalars.parse_float(c)
        elif name == "BaseDateTime":
            c = scalars.parse_timestamp(c)
        elif name == "TransceiverClass":
            c = scalars.parse_class(c)
        else:
            assert name in STRINGS
        return c.alias(name)

    return raw.select(*[column(c) for c in RAW_COLUMNS])


def ingest(spark: SparkSession, folder: str, max_rows: int | None = None) -> DataFrame:
    """The typed rows of a folder of CSV files; ``max_rows`` keeps that many."""
    rows = typed(raw_rows(read_lines(spark, folder)))
    return rows if max_rows is None else rows.limit(max_rows)
