"""Sentence positions without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.sources.shared import materialize

BUCKET_ROWS = 1 << 13
RUN_RANGES = 1 << 13  # key ranges summed up in one task


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def dense_positions(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    out: str = "sentence_id",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """0-based position of each row within its group, in the order of ``key``.

    ``key`` is an integer, unique within a group. A plain ``row_number`` would
    sort a whole group in one task; here rows are numbered inside fixed key
    ranges of at most ``bucket_rows`` keys and shifted by a running sum over the
    small table of range sizes. One group may therefore hold most of the rows.
    The running sum is itself formed in runs of ``RUN_RANGES`` ranges, so no task
    sorts all ranges of a group. Keys should not be scattered over 64 bits: the
    table of ranges would be as long as the data.
    """
    # one struct key: null groups match, and the window and the join share a partitioning
    bucket = F.floor(F.col(key) / F.lit(bucket_rows)).cast("bigint").alias("bucket")
    slots = df.withColumn("__slot", F.struct(*groups, bucket))
    run = F.struct(*[F.col(f"__slot.{g}").alias(g) for g in groups], F.floor(F.col("__slot.bucket") / RUN_RANGES).alias("run"))
    sizes = slots.groupBy("__slot").agg(F.count(F.lit(1)).alias("__n")).withColumn("__run", run)
    in_run = Window.partitionBy("__run").orderBy("__slot.bucket").rowsBetween(Window.unboundedPreceding, -1)
    in_group = [F.col(f"__run.{g}") for g in groups]
    of_runs = Window.partitionBy(*in_group).orderBy("__run.run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.groupBy("__run").agg(F.sum("__n").alias("__total")).select(
        "__run", F.coalesce(F.sum("__total").over(of_runs), F.lit(0)).alias("__base")
    )
    offsets = (
        sizes.withColumn("__before", F.coalesce(F.sum("__n").over(in_run), F.lit(0)))
        .join(runs, "__run")
        .select("__slot", (F.col("__base") + F.col("__before")).alias("__offset"))
    )
    local = F.row_number().over(Window.partitionBy("__slot").orderBy(key))
    return (
        slots.withColumn("__local", local)
        .join(offsets, "__slot")
        .withColumn(out, (F.col("__offset") + F.col("__local") - 1).cast("bigint"))
        .drop("__slot", "__offset", "__local")
    )


def add_sentence_id(
    df: DataFrame,
    key: str,
    groups: Sequence[str] = ("language",),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Position of each sentence within its language."""
    return dense_positions(df, groups, key, "sentence_id", bucket_rows)


def add_global_sentence_id(
    df: DataFrame,
    groups: Sequence[str] = ("language",),
    position: str = "sentence_id",
    out: str = "global_sentence_id",
) -> DataFrame:
    """Position over the concatenation of all groups, ordered by group.

    Only the table of group sizes (one row per language) is ordered as a whole.
    """
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return (
        null_safe_join(df, dimension(offsets), groups)
        .withColumn(out, (F.col("__offset") + F.col(position)).cast("bigint"))
        .drop("__offset")
    )


def scalar(df: DataFrame, value: Column) -> Column:
    """One aggregate of ``df`` as a scalar subquery, so no join is needed."""
    return df.agg(value.alias("value")).scalar()


def dimension(df: DataFrame) -> DataFrame:
    """A small table (languages, labels, names, vocabularies) as the side of a join.

    It is written to the shared folder, so its size is measured, not estimated:
    Spark broadcasts it below the session's threshold, which spares the large
    side a shuffle by a possibly hot key. A larger one is joined by a shuffle
    whose hot partitions adaptive execution splits.
    """
    return materialize(df, "dimension")


CO_LOCATED_BYTES = 1 << 19  # of the rows of a partition; their n-grams in an aggregation take about a hundred times that


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df``, at most that of all tables it reads.

    Without statistics of keys a join is estimated as the product of its sides, and rows
    that are no table have the size ``spark.sql.defaultSizeInBytes``, which says nothing.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    unknown = int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes").rstrip("bB"))
    read = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return min(int(str(plan.stats().sizeInBytes())), sum(n for n in read if n < unknown))


def co_locate(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by ``keys`` ahead of an explode and groupings that contain them.

    The number of partitions is stated, because adaptive execution would merge
    partitions by their size before the explode. It follows from the estimated size
    of the rows, and is at least the session's.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, input_bytes(df) // CO_LOCATED_BYTES), *keys)


DEALT_BYTES = 1 << 22  # of the rows of a partition


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table of more than ``DEALT_BYTES`` per core in partitions of about that size.

    Ahead of an explode whose rows are counted: the splits of a large file hold so many distinct
    terms that the counts of a task leave its memory and are sorted on disk.
    """
    parts = input_bytes(df) // DEALT_BYTES
    return df.repartition(parts) if parts > df.sparkSession.sparkContext.defaultParallelism else df
