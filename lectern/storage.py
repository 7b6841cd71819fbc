"""Intermediate tables in the cluster's shared folder, and plain plan helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most, where a row is some hundred bytes.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. Nothing stands in for one that is not
    set: a folder of this machine would be another disk on each executor."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        # one process, one disk: tests, bench and notebooks
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        folder = context.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lectern_path = path
    if (made := _scratch.get()) is not None:
        made.append(back)
    return back


_scratch: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch():
    """A list of the tables that stored() makes inside the block; at its end
    those still in the list are deleted. What the block hands out must be a
    stored table that is taken off the list."""
    made: list[DataFrame] = []
    token = _scratch.set(made)
    try:
        yield made
    finally:
        _scratch.reset(token)
        for df in made:
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete a table made by stored() that no later plan reads."""
    path = getattr(df, "_lectern_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only for a side counted and found small; beyond the
    limit the planner shuffles both sides and AQE splits skewed keys."""
    return F.broadcast(df) if rows <= limit else df


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is a side of limit rows at most. The
    count looks no further than that."""
    return maybe_broadcast(df, df.limit(limit + 1).count(), limit)


#: Rows of the counted side in a partition of spread().
SPREAD_ROWS = 100_000


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df shuffled by key into partitions that grow in number with rows, not
    in size: AQE merges those of planned shuffles, but leaves these. Joins and
    groups by the key need no other shuffle."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(-(-rows // SPREAD_ROWS))), key)


def numbered(df: DataFrame, order: list, column: str, after: int = 0) -> DataFrame:
    """df with its rank from after + 1 on in a long column. Ranges of rows are
    ranked apart and the counts of the ranges before are added, so no task
    orders more than a range."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = {r[0]: r[1] for r in ranged.groupBy("__range").count().collect()}
    before, so_far = {}, after
    for part in sorted(counts):
        before[part] = so_far
        so_far += counts[part]
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("__range")] if before else F.lit(after)
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn(column, (rank + offset).cast("long")).drop("__range")
