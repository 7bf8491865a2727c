"""Quantiles of a whole column without gathering the column anywhere: exact, or within a stated error of rank.

Each needed order statistic is narrowed down by counting values in equal-width bins; only bin
counts reach the driver. When few enough values are left inside the narrowed interval they are
fetched and ranked. Linear interpolation between neighbouring ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.sequence import union_all
from chronoweave.operators.skew import broadcast_if_small
from chronoweave.session import cut_lineage

BINS = 1024
FETCH = 20_000
#: Values of a group that one task ranks by itself.
GROUP_VALUES = 1_000_000


def quantiles(df: DataFrame, value: Column, probs: list[float], error: float | None = None) -> list[float]:
    """Exact quantiles, or, with ``error``, values of the column whose ranks are off by at most that share of all values.

    The approximate ones come from summaries that tasks make and merge, in one pass.
    """
    if error is None:
        return exact_quantiles(df, value, probs)
    v = value.cast("double")
    found = df.filter(v.isNotNull() & ~F.isnan(v)).agg(F.percentile_approx(v, list(probs), math.ceil(1 / error))).first()[0]
    return list(found) if found else [math.nan] * len(probs)


def group_quantiles(df: DataFrame, by: str, value: str, probs: list[float]) -> DataFrame:
    """``by, q``: each group's exact quantiles, in the order of ``probs``; nulls and NaN do not count.

    Groups that one task can rank are ranked so. Others are narrowed down all at once: the values of each sought rank's interval are
    counted in bins until it holds one value, so a level is one pass and no group is gathered.
    """
    values = df.select(by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = cut_lineage(values.groupBy(by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= GROUP_VALUES:
        return values.groupBy(by).agg(F.percentile("_v", F.array(*[F.lit(p) for p in probs])).alias("q"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("_p"), (F.lit(x) * (F.col("_n") - 1)).alias("_pos")) for i, x in enumerate(probs)]))
    wanted = sizes.select(by, "_n", "_lo", "_hi", at.alias("_w")).select(by, "_n", "_lo", "_hi", "_w.*")
    below, above = F.floor("_pos"), F.least(F.col("_n") - 1, F.floor("_pos") + 1)
    ranks = wanted.withColumn("_rank", F.explode(F.array(below, above))).select(by, "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below"))
    open_, done = cut_lineage(ranks.distinct()), []
    while True:
        done.append(open_.filter("_lo = _hi").select(by, "_rank", F.col("_lo").alias("_value")))
        open_ = open_.filter("_lo < _hi")
        if open_.isEmpty():
            break
        inside = values.join(broadcast_if_small(open_), by).filter("_v >= _lo and _v <= _hi")
        step = (F.col("_hi") - F.col("_lo")) / BINS
        step = F.when((step > 0) & (F.col("_lo") + step != F.col("_lo")), step).otherwise(F.col("_hi") - F.col("_lo"))
        bin_no = F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / step))
        bins = inside.groupBy(by, "_rank", "_below", bin_no.alias("_bin")).agg(F.count("_v").alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        order = Window.partitionBy(by, "_rank").orderBy("_bin")  # BINS rows at most
        bins = bins.withColumn("_before", F.col("_below") + F.sum("_k").over(order) - F.col("_k"))
        open_ = cut_lineage(bins.filter("_rank >= _before and _rank < _before + _k").select(by, "_rank", "_lo", "_hi", F.col("_before").alias("_below")))
    known = union_all(done)
    ends = (wanted.withColumns({"_r": below, "_s": above}).join(known.toDF(by, "_r", "_low"), [by, "_r"]).join(known.toDF(by, "_s", "_high"), [by, "_s"]))
    each = F.struct("_p", (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_pos") - below)).alias("_q"))
    return ends.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["_q"]).alias("q"))


def exact_quantiles(df: DataFrame, value: Column, probs: list[float]) -> list[float]:
    values = df.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    head = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n = head["n"]
    if not n:
        return [math.nan] * len(probs)
    positions = [p * (n - 1) for p in probs]
    ranks = sorted({r for pos in positions for r in (math.floor(pos), min(n - 1, math.floor(pos) + 1))})
    at = _order_statistics(values, ranks, n, head["lo"], head["hi"])
    out = []
    for pos in positions:
        k = math.floor(pos)
        low, high = at[k], at[min(n - 1, k + 1)]
        out.append(low + (high - low) * (pos - k))
    return out


def _order_statistics(values: DataFrame, ranks: list[int], n: int, lo: float, hi: float) -> dict[int, float]:
    """Value at each zero-based rank. Spans are (lo, hi, rows below, rows inside) and do not overlap; every level reads the
    values once, whatever the number of spans: short ones are fetched, the others counted by bins."""
    found: dict[int, float] = {}
    open_ranks = {r: (lo, hi, 0, n) for r in ranks}
    v = F.col("v")
    while open_ranks:
        for r, (a, b, _, _) in list(open_ranks.items()):
            if a == b:
                found[r] = a
                del open_ranks[r]
        spans, small, budget = sorted(set(open_ranks.values())), set(), FETCH
        for i, s in enumerate(spans):
            if s[3] <= budget:
                small.add(i)
                budget -= s[3]
        if not spans:
            break
        which, width = F.lit(None).cast("int"), F.lit(None).cast("double")
        for i, (a, b, _, _) in enumerate(spans):
            step = (b - a) / BINS
            inside = v.between(a, b)
            which = F.when(inside, F.lit(i)).otherwise(which)
            # a short span's values are bins of their own
            bin_no = v if i in small else F.least(F.lit(BINS - 1), F.floor((v - a) / (step if step > 0 and a + step != a else b - a)))
            width = F.when(inside, bin_no.cast("double")).otherwise(width)
        bins = (values.select("v", which.alias("span"), width.alias("bin")).filter("span is not null").groupBy("span", "bin")
                .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("span", "bin").collect())
        of: dict[int, list] = {}
        for row in bins:
            of.setdefault(row["span"], []).append(row)
        for r, s in list(open_ranks.items()):
            seen = s[2]
            for row in of[spans.index(s)]:
                if r < seen + row["n"]:
                    open_ranks[r] = (row["lo"], row["hi"], seen, row["n"])
                    break
                seen += row["n"]
    return found
