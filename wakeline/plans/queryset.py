"""The 31 benchmark queries over position reports."""

from __future__ import annotations

from wakeline.operators.predicates import TrackQuery as Q

# The queries' literals.
VESSEL, VESSELS = 563073700, (563073700, 248669000, 367481310, 367776660, 319194000)
IMO, IMOS = 9348651, (9348651, 9199323, 9826146, 9843807)
NAME, CALL_SIGN = "MAERSK MEMPHIS", "WDK6270"
DAY, WEEK, MONTH = ("2024-10-20", "2024-10-21"), ("2024-10-14", "2024-10-21"), ("2024-10-01", "2024-11-01")
HOUR = ("2024-10-20 04", "2024-10-20 05")
GULF = ((25, 31), (-96, -80))
PUGET_SOUND = ((47, 49), (-124, -122))
NEW_YORK = ((40.5, 41), (-74.5, -73.5))
SAN_DIEGO = ((32.5, 33), (-117.5, -117))
COAST = ((29, 31), (-95, -89))


def _q(category: str, name: str) -> Q:
    return Q(name=name, category=category)


def queries() -> list[Q]:
    return [
        _q("point", "mmsi exact").one_of("MMSI", VESSEL).closing("rows"),
        _q("point", "mmsi multi").one_of("MMSI", *VESSELS),
        _q("point", "imo exact").one_of("IMO", IMO).closing("rows"),
        _q("point", "imo multi").one_of("IMO", *IMOS),
        _q("name", "vessel name exact").one_of("VesselName", NAME).closing("rows"),
        _q("name", "vessel name prefix").prefix("VesselName", "MAERSK"),
        _q("name", "call sign exact").one_of("CallSign", CALL_SIGN).closing("rows"),
        _q("time", "single day").during(*DAY),
        _q("time", "week").during(*WEEK),
        _q("time", "month").during(*MONTH),
        _q("time", "hour").during(*HOUR),
        _q("box", "gulf of mexico").box(*GULF),
        _q("box", "puget sound").box(*PUGET_SOUND),
        _q("box", "new york harbor").box(*NEW_YORK),
        _q("box", "san diego").box(*SAN_DIEGO),
        _q("combined", "mmsi and month").one_of("MMSI", VESSEL).during(*MONTH).closing("rows"),
        _q("combined", "box and week").box(*COAST).during(*WEEK),
        _q("combined", "vessel name and month").one_of("VesselName", NAME).during(*MONTH).closing("rows"),
        _q("combined", "vessel type and box").one_of("VesselType", "70").box(*GULF),
        _q("aggregate", "count all"),
        _q("aggregate", "vessel types").closing("groups", "VesselType"),
        _q("aggregate", "days").closing("days"),
        _q("aggregate", "distinct mmsi").closing("distinct", "MMSI"),
        _q("bloom", "call sign probe").one_of("CallSign", "WDJ6270"),
        _q("bloom", "call sign absent").one_of("CallSign", "ZZZZZZZZ"),
        _q("bloom", "vessel name probe").one_of("VesselName", NAME),
        _q("bloom", "vessel name absent").one_of("VesselName", "NONEXISTENT SHIP NAME"),
        _q("bloom", "imo probe").one_of("IMO", IMO),
        _q("bloom", "imo placeholder").one_of("IMO", 1),
        _q("bloom", "call sign prefix").prefix("CallSign", "WDK"),
        _q("bloom", "vessel name substring").substring("VesselName", "SPIRIT"),
    ]
