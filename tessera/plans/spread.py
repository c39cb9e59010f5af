"""Spreads small tables over all cores before work that costs far more than moving their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` in a few partitions for each core if its scan can't fill them, by the bytes that the plan expects; as it is otherwise.

    Only tables of less than one full split for each core are moved, so what is shuffled has a bound; a larger
    table has splits enough. A file of one row group is one split's rows however many splits it is cut into.
    """
    if df.isStreaming:
        return df
    session = df.sparkSession._jsparkSession
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if size < cores * session.sessionState().conf().filesMaxPartitionBytes() else df
