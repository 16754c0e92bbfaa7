"""Timing runs, consistency between layouts, reports and parameter sweeps.

Speed-up is always baseline time over candidate time: more than 1 is faster.
"""

from __future__ import annotations

import json
import math
import statistics
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Timing:
    query: str
    layout: str
    count: int | None
    seconds: list[float] = field(default_factory=list)
    status: str = "ok"  # or "timeout", "error: ..."

    @property
    def median(self) -> float:
        return statistics.median(self.seconds) if self.seconds else math.nan

    @property
    def mean(self) -> float:
        return statistics.fmean(self.seconds) if self.seconds else math.nan


def timed(spark: SparkSession, query: str, layout: str, run: Callable[[], int], repeats: int = 2, warmups: int = 1, timeout: float = 300.0) -> Timing:
    """Run a query a few times; a run beyond the timeout is cancelled and recorded as such."""
    out = Timing(query, layout, None)
    for n in range(warmups + repeats):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, query, interruptOnCancel=True)
        timer = threading.Timer(timeout, spark.sparkContext.cancelJobGroup, [group])
        timer.start()
        start = time.perf_counter()
        try:
            out.count = run()
        except Exception as e:
            out.status = "timeout" if time.perf_counter() - start >= timeout else f"error: {e}".splitlines()[0]
            return out
        finally:
            timer.cancel()
        if n >= warmups:
            out.seconds.append(time.perf_counter() - start)
    return out


def check_consistency(timings: list[Timing]) -> None:
    """Raise if layouts disagree on a query's count."""
    seen: dict[str, dict[str, int | None]] = {}
    for t in timings:
        if t.status == "ok":
            seen.setdefault(t.query, {})[t.layout] = t.count
    bad = {q: counts for q, counts in seen.items() if len(set(counts.values())) > 1}
    if bad:
        raise AssertionError(f"layouts disagree: {bad}")


def geometric_mean(values: list[float]) -> float:
    return math.exp(statistics.fmean(map(math.log, values))) if values else math.nan


def speedup(baseline: float, candidate: float) -> float:
    return baseline / candidate


def markdown(timings: list[Timing], best: int = 5) -> str:
    """A table of medians by query and layout, and the fastest layouts of each query."""
    layouts = list(dict.fromkeys(t.layout for t in timings))
    rows: dict[str, dict[str, Timing]] = {}
    for t in timings:
        rows.setdefault(t.query, {})[t.layout] = t
    lines = ["| query | count | " + " | ".join(layouts) + " | fastest |", "|---|---:|" + "---:|" * len(layouts) + "---|"]
    for query, own in rows.items():
        ok = sorted((t for t in own.values() if t.status == "ok"), key=lambda t: t.median)[:best]
        cells = [(f"{own[x].median:.4f}" if own[x].status == "ok" else own[x].status) if x in own else "-" for x in layouts]
        count = next((str(t.count) for t in ok), "-")
        lines.append(f"| {query} | {count} | " + " | ".join(cells) + " | " + ", ".join(t.layout for t in ok) + " |")
    return "\n".join(lines) + "\n"


def as_json(timings: list[Timing]) -> str:
    return json.dumps([t.__dict__ | {"median": t.median, "mean": t.mean} for t in timings], indent=1)


def sweep_table(results: DataFrame, row: str, column: str, value: str = "seconds") -> DataFrame:
    """Geometric means of a sweep's times, one row and column per parameter value."""
    return results.groupBy(row).pivot(column).agg(F.exp(F.avg(F.log(value)))).orderBy(row)


def best_cell(results: DataFrame, parameters: list[str], value: str = "seconds") -> DataFrame:
    """The parameters with the smallest geometric mean of times."""
    means = results.groupBy(*parameters).agg(F.exp(F.avg(F.log(value))).alias("geo_mean"))
    return means.orderBy("geo_mean", *parameters).limit(1)


def size_label(n: int) -> str:
    """64K, 1M, ... for whole multiples."""
    for unit, sign in ((1_000_000, "M"), (1_000, "K")):
        if n >= unit and n % unit == 0:
            return f"{n // unit}{sign}"
    return str(n)


def byte_label(n: int) -> str:
    for unit, sign in ((1 << 20, "MB"), (1 << 10, "KB")):
        if n >= unit and n % unit == 0:
            return f"{n // unit}{sign}"
    return str(n)
