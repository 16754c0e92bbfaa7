"""Roll-up of positions by vessel identity: last known values and the ordered track.

One aggregation and one exchange; identities with equal keys meet null-safely.  A long
track can also be kept as one row a day, so no row grows beyond a day's positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.scalars import first_digit
from wakeline.schema import IDENTITY_KEYS, LAST_VALUES, POSITION_FIELDS


def last_known(value: str, order: Column) -> Column:
    """The value of the last row in order that has one."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), order))


def in_time(time: str, ties: list[str]) -> Column:
    """Order by time, null times last, ties by the other columns."""
    return F.struct(F.col(time).isNull().alias("late"), F.col(time).alias("at"), *[F.col(c).alias(f"tie{n}") for n, c in enumerate(ties)])


def identities(
    df: DataFrame,
    keys: tuple[str, ...] = IDENTITY_KEYS,
    time: str = "BaseDateTime",
    last: tuple[str, ...] = LAST_VALUES,
    fields: tuple[str, ...] = POSITION_FIELDS,
    daily: bool = False,
    positions: bool = True,
) -> DataFrame:
    """One row per identity (per day too, with ``daily``): LastKnownDate, last known values, Positions in time order.

    Without ``positions`` a row has their number, N, instead, and no row grows with a track.
    """
    ties = [c for c in fields if c != time] + [c for c in last if c not in fields]
    order = in_time(time, ties)
    by = [*keys, *([F.to_date(time).alias("Day")] if daily else [])]
    grouped = df.groupBy(*by).agg(
        F.max(time).alias("LastKnownDate"),
        *[last_known(c, order).alias(c if c not in ("LAT", "LON") else f"Last{c}") for c in last],
        F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*fields).alias("p")))).alias("Positions") if positions else F.count(F.lit(1)).alias("N"),
    )
    if not positions:
        return grouped
    return grouped.withColumn("Positions", F.transform("Positions", lambda x: x["p"]))


def write_identities(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Identities partitioned by the first digit of their MMSI."""
    digit = df.withColumn("mmsi_prefix", first_digit(F.col("MMSI")))
    digit.repartition("mmsi_prefix", *[c for c in IDENTITY_KEYS if c in df.columns]).write.mode(mode).partitionBy("mmsi_prefix").parquet(path)
