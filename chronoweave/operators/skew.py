"""Joins and broadcasts that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

# A key is hot above this many rows, whatever the table's size: what one task takes.
HOT_ROWS = 1_000_000
# Classes of keys that are counted before the keys are.
HASHED = 8192
# Rows of fixed width below which a table is broadcast.
BROADCAST_ROWS = 200_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> tuple[DataFrame | None, int]:
    """Keys with more rows than one task should take, as a written table with the number of parts each needs.

    Counts are combined before the shuffle. The table has at most ``rows / budget`` rows; nothing is collected. Where no class of keys
    with one hash has so many rows, no key has, and keys are not counted one by one.
    """
    budget = max(hot_rows if hot_rows is not None else HOT_ROWS, 1)
    classes = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(HASHED)).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > budget)
    if hot_rows is None and classes.isEmpty():
        return None, budget
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > budget)
    hot = cut_lineage(counts.select(*keys, F.ceil(F.col("_n") / budget).cast("int").alias("_parts")))
    return (None, budget) if hot.isEmpty() else (hot, budget)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                hot_rows: int | None = None) -> DataFrame:
    """Equi join in which a hot key of ``big`` is spread over several tasks.

    Rows of ``big`` with a hot key get a random-looking part number; the matching rows of
    ``small`` are repeated once per part. Cold keys are untouched (part 0). Neither side is broadcast: Spark's estimate of
    a side knows the files it comes from, not the rows that were exploded since.
    """
    hot, _ = hot_keys(big, keys, hot_rows)
    if hot is None:
        return big.join(small.hint("merge"), keys, how)
    hot = broadcast_if_small(hot)
    others = [F.col(c) for c in big.columns if c not in keys]
    # rows that have nothing but their key are told apart by their place in the task
    spread = F.pmod(F.xxhash64(*others) if others else F.monotonically_increasing_id(), F.col("_parts"))
    left = big.join(hot, keys, "left").withColumn("_part", F.coalesce(spread, F.lit(0)).cast("int")).drop("_parts")
    right = (small.join(hot, keys, "left")
             .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
             .drop("_parts"))
    return left.join(right.hint("merge"), [*keys, "_part"], how).drop("_part")


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, reading no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                max_rows: int = BROADCAST_ROWS, hot_rows: int | None = None) -> DataFrame:
    """Broadcast ``small`` when its size is checked, otherwise shuffle with hot keys spread."""
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how, hot_rows)


SMALL_ROWS = 2_000_000
PART_ROWS = 100_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Give a small table to every core before each of its rows is expanded into many.

    A few files, or a coalesced shuffle, would otherwise run the expansion in one or two tasks.
    A larger table may also come in one partition, as a compressed file of some megabytes holds millions of rows: its tasks then take
    ``PART_ROWS`` rows each.
    """
    rows = df.limit(SMALL_ROWS + 1).count() if rows is None else rows
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least if rows <= SMALL_ROWS else max(least, -(-df.count() // PART_ROWS)))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as a shuffle has, without counting it."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
