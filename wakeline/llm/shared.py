"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir, and columns computed in Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType


BATCH = 1000  # most rows that a worker holds at once; texts may be long


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in the session; a smaller setting of its own stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH:
        spark.conf.set(setting, str(BATCH))


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable with the folder that the session names.

    Without one, a session within one process (tests) gets a temporary folder; on a cluster that is an error.
    """
    small_batches(spark)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wakeline-"))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # Spark's own setting: shuffle files go when the query that wrote them ends


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint.

    The shuffle files behind it go as soon as it is written, whatever still refers to them; the setting is the session's own again for later queries.
    """
    spark = df.sparkSession
    use_checkpoints(spark)
    own = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # planned anew, under the setting
    finally:
        spark.conf.set(CLEANUP, own)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that the frame lacks, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    end = ""
    while any(f"__{n}{end}".lower() in taken for n in names):
        end += "_"
    return [f"__{n}{end}" for n in names]


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints that no DataFrame refers to any more; otherwise they stay until the driver happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()


def append_columns(df: DataFrame, make, inputs: list[str], outputs: list[tuple[str, DataType]]) -> DataFrame:
    """The rows as they came with more columns, computed in Arrow batches.

    ``make()`` is called once per worker and returns a function of the input columns' values (lists) that
    returns one list or array per output.  The other columns pass as Arrow arrays, whatever their types and nulls.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(df.sparkSession)
    kinds = [to_arrow_type(kind) for _, kind in outputs]
    names = [*df.columns, *[n for n, _ in outputs]]

    def run(batches):
        function = make()
        for batch in batches:
            at = [df_columns.index(c) for c in inputs]
            values = function(*[batch.column(i).to_pylist() for i in at])
            more = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    df_columns = list(df.columns)
    return df.mapInArrow(run, StructType([*df.schema.fields, *[StructField(n, k) for n, k in outputs]]))
