"""Joins of time intervals that overlap, whatever their lengths, without listing the instants of any.

An interval belongs to the class of the power of two that its length reaches, and touches two buckets of its class at
most. It is listed there, and in the buckets it touches of every wider class in use: again two at most for each of the
sixty classes that a long can have. Two intervals that overlap share the bucket, of the wider one's class, in which their
overlap begins, and are reported there alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.skew import HOT_ROWS, hot_keys, salted_join

#: No class is narrower than this many units.
LEAST_WIDTH = 1


def width_of(length: Column, doublings: int = 1) -> Column:
    """The power of two that a length reaches, of those so many doublings apart."""
    reached = F.ceil(F.log2(F.greatest(length + 1, F.lit(LEAST_WIDTH)).cast("double")) / doublings) * doublings
    exact = F.pow(F.lit(2.0), F.least(F.lit(62), reached) if doublings > 1 else reached)
    return F.greatest(F.lit(LEAST_WIDTH), exact).cast("long")


def _touched(low: str, high: str, width: Column) -> Column:
    return F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
                hot_rows: int | None = None, doublings: int = 1) -> DataFrame:
    """Rows of both sides with equal keys and overlapping closed intervals of whole numbers, each pair once.

    The sides have no columns in common but the keys. Rows with a null end or an end before their start overlap nothing. A bucket
    in which very many intervals meet is spread over several tasks. More ``doublings`` from one class to the next list a row fewer
    times, for more candidates in a bucket: right where few intervals of a key overlap.
    """
    (a, b), (c, d) = left_span, right_span
    lefts = left.filter(F.col(a) <= F.col(b)).withColumn("_lw", width_of(F.col(b) - F.col(a), doublings))
    rights = right.filter(F.col(c) <= F.col(d)).withColumn("_rw", width_of(F.col(d) - F.col(c), doublings))
    # one number a class: sixty-odd at most on each side
    used = {side: sorted(r[0] for r in df.select(w).distinct().collect()) for side, df, w in (("l", lefts, "_lw"), ("r", rights, "_rw"))}

    def listed(df: DataFrame, low: str, high: str, own: str, widths: list[int], wider: bool) -> DataFrame:
        """In the buckets of its own class, or in those of the other side's classes that are wider than it."""
        if not wider:
            return df.withColumnRenamed(own, "_width").withColumn("_bucket", F.explode(_touched(low, high, F.col("_width"))))
        classes = F.filter(F.array(*[F.lit(w).cast("long") for w in widths] or [F.lit(None).cast("long")]), lambda w: w > F.col(own))
        return df.withColumn("_width", F.explode(classes)).drop(own).withColumn("_bucket", F.explode(_touched(low, high, F.col("_width"))))

    at = [*keys, "_width", "_bucket"]
    begins = F.floor(F.greatest(F.col(a), F.col(c)) / F.col("_width")) == F.col("_bucket")
    meets = begins & (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b))
    # a bucket holds a row of its key twice at most for each class: without a crowded key no bucket need be counted
    most = max((HOT_ROWS if hot_rows is None else hot_rows) // (2 * (len(used["r"]) + 1)), 1)
    crowded = hot_keys(lefts, keys, most)[0] is not None

    def join(big: DataFrame, small: DataFrame) -> DataFrame:
        return salted_join(big, small, at, hot_rows=hot_rows) if crowded else big.join(small.hint("merge"), at)

    # the right interval's class is the wider one or the same; then the left one's is
    up = listed(lefts, a, b, "_lw", used["r"], True).unionByName(listed(lefts, a, b, "_lw", [], False))
    one = join(up, listed(rights, c, d, "_rw", [], False))
    two = join(listed(lefts, a, b, "_lw", [], False), listed(rights, c, d, "_rw", used["l"], True))
    return one.unionByName(two).filter(meets).drop("_width", "_bucket")
