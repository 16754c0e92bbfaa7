"""Parameter sweeps over layout settings: write each cell's layout, time the query set on it, report.

A cell that has results already is not run again, so a sweep can be continued.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.predicates import TrackQuery
from wakeline.plans.planner import plan
from wakeline.plans.queryset import queries as query_set
from wakeline.reporting import byte_label, geometric_mean, size_label, speedup, sweep_table, timed
from wakeline.sources.layouts import LAYOUTS, Layout, exists, read_layout, read_text, write_layout, write_text

log = logging.getLogger(__name__)

# The settings that are compared.
ROW_GROUP_ROWS = (100_000, 500_000, 1_000_000, 5_000_000)
PAGE_BYTES = (65_536, 262_144, 1_048_576)
BLOOM_FPP = (0.1, 0.01, 0.001)
BLOOM_NDV = (100_000, 1_000_000, 10_000_000)
COLUMN_NDV = {"MMSI": 50_000, "IMO": 1_000, "CallSign": 2_000, "VesselName": 2_000, "VesselType": 100}

BASE = LAYOUTS["partitioned_curve_bloom"]
LOOKUPS = ("point", "bloom")  # categories that bloom filters can help


@dataclass(frozen=True)
class Cell:
    """A layout with the two settings (as labels) that its experiment varies."""

    experiment: str
    row: str
    column: str
    layout: Layout
    default: bool = False  # what the experiment's other cells are compared with
    smart: bool = False
    categories: tuple[str, ...] = field(default=())  # of the queries that count; all if empty

    @property
    def name(self) -> str:
        return f"{self.row}-{self.column}".replace(" ", "_")


def cells(base: Layout = BASE) -> list[Cell]:
    """Row groups x pages, bloom rates x expected values, and the combination of the best against the defaults."""
    out = [
        Cell("row groups x pages", size_label(n), byte_label(b), replace(base, row_group_rows=n, page_bytes=b), (n, b) == (1_000_000, 1_048_576))
        for n, b in product(ROW_GROUP_ROWS, PAGE_BYTES)
    ]
    out += [
        Cell("bloom rate x values", str(p), size_label(n), replace(base, bloom_fpp=p, bloom_ndv=n), (p, n) == (0.01, 1_000_000), categories=LOOKUPS)
        for p, n in product(BLOOM_FPP, BLOOM_NDV)
    ]
    best = replace(base, row_group_rows=5_000_000, page_bytes=65_536, bloom_fpp=0.001, bloom_ndv=10_000_000, bloom_ndv_by_column=COLUMN_NDV, blooms=tuple(COLUMN_NDV))
    return [*out, Cell("combined", "baseline", "all", base, True, smart=True), Cell("combined", "optimal", "all", best, smart=True)]


def run(spark: SparkSession, df: DataFrame, folder: str, chosen: Iterable[Cell] | None = None, queries: list[TrackQuery] | None = None, repeats: int = 2, warmups: int = 1, timeout: float = 300) -> None:
    """Time the queries on each cell's layout of a table; results go to ``<folder>/results/<experiment>/<cell>.json``."""
    for cell in cells() if chosen is None else chosen:
        at = f"{cell.experiment.replace(' ', '_')}/{cell.name}"
        result = f"{folder}/results/{at}.json"
        if exists(spark, result):
            log.info("%s: has results, left out", at)
            continue
        log.info("%s: writing and timing", at)
        write_layout(df, f"{folder}/layouts/{at}", cell.layout, overwrite=True, smart=cell.smart)
        held, layout = read_layout(spark, f"{folder}/layouts/{at}")
        rows = []
        for q in query_set() if queries is None else queries:
            if cell.categories and q.category not in cell.categories:
                continue
            planned = plan(held, q, layout)
            t = timed(spark, q.name, at, lambda q=q, p=planned: p.count() if q.operation == "rows" else p.first()["n"], repeats, warmups, timeout)
            if t.status == "ok":
                rows.append({"experiment": cell.experiment, "row": cell.row, "column": cell.column, "standard": cell.default, "query": q.name, "n": t.count, "seconds": t.median})
        write_text(spark, result, "\n".join(map(json.dumps, rows)))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All results of a sweep: experiment, row, column, standard, query, n, seconds."""
    return spark.read.schema("experiment string, row string, column string, standard boolean, query string, n long, seconds double").json(f"{folder}/results/*/*.json")


def speedups(found: DataFrame) -> DataFrame:
    """The results with ``speedup``: the standard cell's time over their own; more than 1 is faster."""
    standard = found.where("standard").select("experiment", "query", F.col("seconds").alias("standard_seconds"))
    return found.where("seconds > 0").join(standard, ["experiment", "query"]).withColumn("speedup", F.col("standard_seconds") / F.col("seconds"))


def report(spark: SparkSession, folder: str) -> str:
    """Markdown: geometric means of speed-ups by setting, the best cell and its queries, for each experiment."""
    found = speedups(results(spark, folder))
    lines = ["# Parameter sweep", "", "Speed-ups are geometric means over the queries against the standard settings; more than 1 is faster."]
    order = [*dict.fromkeys(c.experiment for c in cells())]
    for experiment in order:
        own = found.where(F.col("experiment") == experiment)
        rows = [r.asDict() for r in own.collect()]  # queries times cells
        lines += ["", f"## {experiment}", ""]
        if not rows:
            lines.append("No results.")
            continue
        columns = [*dict.fromkeys(c.column for c in cells() if c.experiment == experiment)]
        table = {r["row"]: r for r in sweep_table(own, "row", "column", "speedup").collect()}
        lines += ["| | " + " | ".join(columns) + " |", "|---|" + "---:|" * len(columns)]
        for row in dict.fromkeys(c.row for c in cells() if c.experiment == experiment):
            values = table[row].asDict() if row in table else {}
            lines.append(f"| {row} | " + " | ".join(f"{values[c]:.2f}x" if values.get(c) else "-" for c in columns) + " |")
        by_cell: dict[tuple, list[dict]] = {}
        for r in rows:
            by_cell.setdefault((r["row"], r["column"]), []).append(r)
        best = max(by_cell, key=lambda c: geometric_mean([r["speedup"] for r in by_cell[c]]))
        lines += ["", f"Best: {best[0]}, {best[1]} ({geometric_mean([r['speedup'] for r in by_cell[best]]):.2f}x)", "", "| query | standard s | best s | speed-up |", "|---|---:|---:|---:|"]
        lines += [f"| {r['query']} | {r['standard_seconds']:.4f} | {r['seconds']:.4f} | {speedup(r['standard_seconds'], r['seconds']):.2f}x |" for r in sorted(by_cell[best], key=lambda r: r["query"])]
    return "\n".join(lines) + "\n"
