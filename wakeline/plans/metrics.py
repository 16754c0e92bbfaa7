"""What a query read: scan metrics of the executed plan, and what each kind of pruning spares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Read options that switch one kind of row group pruning off.
SWITCHES = {
    "stats": "parquet.filter.stats.enabled",
    "bloom": "parquet.filter.bloom.enabled",
    "dictionary": "parquet.filter.dictionary.enabled",
    "column_index": "parquet.filter.columnindex.enabled",
}


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """Run a query; files and rows that its scans read."""
    df._jdf.queryExecution().toRdd().count()  # on the executors; no row comes to the driver
    found: dict[str, int] = {}

    def walk(node) -> None:
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Scan"):
            metrics = node.metrics()
            for key, own in (("numFiles", "files"), ("numOutputRows", "rows")):
                if metrics.contains(key):
                    found[own] = found.get(own, 0) + metrics.apply(key).value()
        children = node.children()
        for n in range(children.size()):
            walk(children.apply(n))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def pruning(spark: SparkSession, path: str, query: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Rows decoded with everything on, and with each kind of pruning off."""
    out = {"rows": scan_metrics(query(spark.read.parquet(path))).get("rows", 0)}
    for name, switch in SWITCHES.items():
        df = spark.read.option(switch, "false").parquet(path)
        out[f"rows_without_{name}"] = scan_metrics(query(df)).get("rows", 0)
    return out
