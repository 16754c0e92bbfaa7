"""Column sets of position reports: raw text, typed, and rolled up by identity."""

from __future__ import annotations

from pyspark.sql import types as T

# The public column names of the position reports, in file order.
RAW_COLUMNS = (
    "MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading", "VesselName", "IMO",
    "CallSign", "VesselType", "Status", "Length", "Width", "Draft", "Cargo", "TransceiverClass",
)
LONGS = ("MMSI",)
FLOATS = ("LAT", "LON", "SOG", "COG", "Heading", "Length", "Width", "Draft")
STRINGS = ("VesselName", "CallSign", "VesselType", "Status", "Cargo")

RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def _kind(name: str) -> T.DataType:
    if name in ("MMSI", "IMO"):
        return T.LongType()
    if name in FLOATS:
        return T.FloatType()
    if name == "BaseDateTime":
        return T.TimestampNTZType()
    return T.BooleanType() if name == "TransceiverClass" else T.StringType()


TYPED = T.StructType([T.StructField(c, _kind(c)) for c in RAW_COLUMNS])

IDENTITY_KEYS = ("MMSI", "IMO", "CallSign", "VesselName")
LAST_VALUES = ("TransceiverClass", "Draft", "Length", "Width", "VesselType", "LAT", "LON")
POSITION_FIELDS = ("BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading")
