"""Ordered per-key computations (neighbours, running sums, row numbers) that tolerate huge keys.

``Timeline`` orders each key's rows by time and a unique tie-breaker. An ordinary key is one
window group. A key with more rows than one task should take is cut into consecutive blocks;
each block is its own window group and a small table of block edges (first row, last row,
running totals) carries values across block borders. The answer is the same either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.skew import broadcast_if_small, hot_keys
from chronoweave.session import cut_lineage


class Timeline:
    def __init__(self, df: DataFrame, keys: list[str], time: str, tie: str, hot_rows: int | None = None, cold: bool = False):
        """``cold``: the caller knows that no key has too many rows."""
        self.keys, self.time, self.tie = list(keys), time, tie
        self.blocks: list[str] = []
        self.df, self.split = (df, False) if cold else self._cut(df, hot_rows)

    # ------------------------------------------------------------------ block layout

    def _cut(self, df: DataFrame, hot_rows: int | None) -> tuple[DataFrame, bool]:
        """Number the blocks. Level by level, every group still above the row budget is divided
        evenly by time, or by tie-breaker when all its rows share one instant, until none is left
        that can be divided. Each level leaves a fraction of a group's range, so levels end."""
        hot, budget = hot_keys(df, self.keys, hot_rows)
        if hot is None:
            return df, False
        out, group = df, list(self.keys)
        while True:
            name = f"_b{len(group) - len(self.keys)}"
            # one row for each group with more rows than the budget
            wide = cut_lineage(out.groupBy(*group)
                               .agg(F.count(F.lit(1)).alias("_n"),
                                    F.min(self.time).alias("_t0"), F.max(self.time).alias("_t1"),
                                    F.min(self.tie).alias("_i0"), F.max(self.tie).alias("_i1"))
                               .filter(F.col("_n") > budget).filter((F.col("_t0") < F.col("_t1")) | (F.col("_i0") < F.col("_i1"))))
            if wide.isEmpty():
                break
            parts = F.ceil(F.col("_n") / budget) * 2
            by_time = F.col("_t0") < F.col("_t1")

            def share(column: str, low: str, high: str) -> Column:
                return (F.col(column) - F.col(low)) / (F.col(high) - F.col(low))

            pos = F.when(by_time, share(self.time, "_t0", "_t1")).otherwise(share(self.tie, "_i0", "_i1"))
            block = F.coalesce(F.least(parts - 1, F.floor(pos * parts)), F.lit(0)).cast("int")
            out = out.join(broadcast_if_small(wide), group, "left").withColumn(name, block).drop("_n", "_t0", "_t1", "_i0", "_i1")
            group = [*group, name]
        self.blocks = group[len(self.keys):]
        if not self.blocks:  # hot, yet every row shares one instant and one tie-breaker
            return df, False
        self.hot_keys = broadcast_if_small(hot.select(*self.keys))
        return out, True

    @property
    def group(self) -> list[str]:
        return [*self.keys, *self.blocks]

    @property
    def order(self) -> list[str]:
        return [self.time, self.tie]

    def _edges(self, df: DataFrame, **aggs: Column) -> DataFrame:
        """One row per block of the hot keys only (a bounded table)."""
        return (df.join(self.hot_keys, self.keys, "left_semi")
                .groupBy(*self.group).agg(*[a.alias(n) for n, a in aggs.items()]))

    def _carry(self, df: DataFrame, edges: DataFrame) -> DataFrame:
        return df.join(broadcast_if_small(edges), self.group, "left")

    # ------------------------------------------------------------------ operators

    def neighbours(self, previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None) -> "Timeline":
        """Add columns holding a value of the previous / next row of the same key."""
        previous, following = previous or {}, following or {}
        w = Window.partitionBy(*self.group).orderBy(*self.order)
        out = self.df.withColumns({
            **{n: F.lag(e).over(w) for n, e in previous.items()},
            **{n: F.lead(e).over(w) for n, e in following.items()},
        })
        if self.split:
            at = F.struct(*self.order)
            edges = self._edges(
                self.df,
                _last=F.max_by(F.struct(*[e.alias(n) for n, e in previous.items()] or [F.lit(0).alias("_")]), at),
                _first=F.min_by(F.struct(*[e.alias(n) for n, e in following.items()] or [F.lit(0).alias("_")]), at),
                _lo=F.min(at), _hi=F.max(at),
            )
            across = Window.partitionBy(*self.keys).orderBy(*self.blocks)
            edges = edges.withColumns({"_before": F.lag("_last").over(across), "_after": F.lead("_first").over(across)})
            out = self._carry(out, edges.drop("_last", "_first"))
            is_first, is_last = at == F.col("_lo"), at == F.col("_hi")
            out = out.withColumns({
                **{n: F.when(is_first, F.col("_before")[n]).otherwise(F.col(n)) for n in previous},
                **{n: F.when(is_last, F.col("_after")[n]).otherwise(F.col(n)) for n in following},
            }).drop("_before", "_after", "_lo", "_hi")
        return self._with(out)

    def running(self, **sums: Column) -> "Timeline":
        """Add running totals up to and including the row (a row number is the total of 1)."""
        w = Window.partitionBy(*self.group).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        out = self.df.withColumns({n: F.sum(e).over(w) for n, e in sums.items()})
        if self.split:
            edges = self._edges(self.df, **{f"_s_{n}": F.sum(e) for n, e in sums.items()})
            before = (Window.partitionBy(*self.keys).orderBy(*self.blocks)
                      .rowsBetween(Window.unboundedPreceding, -1))
            edges = edges.withColumns({f"_o_{n}": F.sum(f"_s_{n}").over(before) for n in sums})
            out = self._carry(out, edges.drop(*[f"_s_{n}" for n in sums]))
            out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in sums}) \
                .drop(*[f"_o_{n}" for n in sums])
        return self._with(out)

    def prior_max(self, **values: Column) -> "Timeline":
        """Add the greatest value among all earlier rows of the key (null on the first)."""
        w = Window.partitionBy(*self.group).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        out = self.df.withColumns({n: F.max(e).over(w) for n, e in values.items()})
        if self.split:
            edges = self._edges(self.df, **{f"_s_{n}": F.max(e) for n, e in values.items()})
            before = (Window.partitionBy(*self.keys).orderBy(*self.blocks)
                      .rowsBetween(Window.unboundedPreceding, -1))
            edges = edges.withColumns({f"_o_{n}": F.max(f"_s_{n}").over(before) for n in values})
            out = self._carry(out, edges.drop(*[f"_s_{n}" for n in values]))
            out = out.withColumns({n: F.greatest(F.col(n), F.col(f"_o_{n}")) for n in values}) \
                .drop(*[f"_o_{n}" for n in values])
        return self._with(out)

    def key_minimum(self, **values: Column) -> "Timeline":
        """Add each key's minimum of an expression."""
        w = Window.partitionBy(*self.group)
        out = self.df.withColumns({n: F.min(e).over(w) for n, e in values.items()})
        if self.split:
            low = (self.df.join(self.hot_keys, self.keys, "left_semi").groupBy(*self.keys)
                   .agg(*[F.min(e).alias(f"_m_{n}") for n, e in values.items()]))
            out = out.join(broadcast_if_small(low), self.keys, "left")
            out = out.withColumns({n: F.coalesce(F.col(f"_m_{n}"), F.col(n)) for n in values}) \
                .drop(*[f"_m_{n}" for n in values])
        return self._with(out)

    def adding(self, **columns: Column) -> "Timeline":
        """Add columns made from the row itself."""
        return self._with(self.df.withColumns(columns))

    def _with(self, df: DataFrame) -> "Timeline":
        other = object.__new__(Timeline)
        other.__dict__.update(self.__dict__)
        other.df = df
        return other

    def result(self) -> DataFrame:
        return self.df.drop(*self.blocks)


def key_offsets(counts: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Exclusive prefix sums over all keys in key order, without a one-task window.

    The key table is range-partitioned and written; each partition is summed on its own and
    only the per-partition totals (one row each) are combined.
    """
    valued = counts.withColumns({f"_v_{n}": e for n, e in sums.items()})
    ranged = cut_lineage(valued.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before_all = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = totals.select("_pid", *[
        F.coalesce(F.sum(f"_t_{n}").over(before_all), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.join(F.broadcast(starts), "_pid")
            .withColumns({n: F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
            .drop("_pid", *[f"_s_{n}" for n in sums], *[f"_v_{n}" for n in sums]))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
