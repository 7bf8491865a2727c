"""Greedy walks along a path, where each decision depends on the last row kept.

A user's path is cut into bounded blocks. Every block is walked on its own from a guessed
starting state; then each block whose real starting state (the state the previous block ended
with) differs from the one it used is walked again, until none differs. The result is exactly
that of one walk from start to end, and no task ever holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronoweave.operators.sequence import Timeline
from chronoweave.session import cut_lineage, ship_package

BLOCK_ROWS = 50_000
BATCH_MARKS = 20_000  # marks that a task sends on at a time

Step = Callable[[dict[str, np.ndarray], dict | None], tuple[list, dict | None]]


def _earth(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000.0 * float(np.arcsin(min(1.0, np.sqrt(h))))


def _walker(group: list[str], tie: str, step: Step, state: list[str], walked: T.StructType) -> Callable:
    """Walk rows that stand in order, group after group: one row a group with its marks, start and end state."""

    def done(key: tuple, parts: list[dict]) -> dict:
        block = parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        start = None if np.isnan(block[f"s_{state[0]}"][0]) else {c: float(block[f"s_{c}"][0]) for c in state}
        marks, end = step(block, start)
        return {**dict(zip(group, key)), "marks": [{"tie": t, "mark": m} for t, m in zip(block[tie].tolist(), marks)],
                **{f"s_{c}": None if start is None else start[c] for c in state},
                **{f"e_{c}": None if end is None else end[c] for c in state}}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(walked)
        out, parts, last, size = [], [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            keys = list(zip(*[columns[c].to_pylist() for c in group]))
            values = {c: v.to_numpy(zero_copy_only=False) for c, v in columns.items() if c not in group}
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            begin = 0
            for end in ends:
                if parts and keys[begin] != last:
                    out.append(done(last, parts))
                    size, parts = size + len(out[-1]["marks"]), []
                    if size >= BATCH_MARKS:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                last = keys[begin]
                parts.append({c: v[begin:end] for c, v in values.items()})
                begin = end
        if parts:
            out.append(done(last, parts))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return walk


def chained(df: DataFrame, key: str, time: str, tie: str, columns: list[str], step: Step,
            state: list[str], out_type: T.DataType, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``mark`` to every row: what ``step`` returns for it.

    ``step(block, start_state) -> (marks, end_state)``; states are dicts of floats.
    """
    ship_package(df.sparkSession)
    line = Timeline(df.select(key, time, tie, *columns), [key], time, tie, hot_rows=block_rows)
    blocks = line.blocks
    rows = line.df if blocks else line.df.withColumn("_b0", F.lit(0))
    blocks = blocks or ["_b0"]
    group = [key, *blocks]
    if line.split:
        rows = cut_lineage(rows)

    fields = [rows.schema[c] for c in group]
    walked = T.StructType([*fields, T.StructField("marks", T.ArrayType(T.StructType([
        T.StructField("tie", rows.schema[tie].dataType), T.StructField("mark", out_type)]))),
        *[T.StructField(f"s_{c}", T.DoubleType()) for c in state],
        *[T.StructField(f"e_{c}", T.DoubleType()) for c in state]])

    def walk(df: DataFrame) -> DataFrame:
        # groups may be many and tiny, so a task takes them one after the other instead of one call each
        order = [F.col(time).asc_nulls_last(), F.col(tie).asc_nulls_last()]
        return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(_walker(group, tie, step, state, walked), walked)

    nothing = {f"s_{c}": F.lit(None).cast("double") for c in state}
    result = walk(rows.withColumns(nothing))
    if line.split:
        result = cut_lineage(result)
        order = Window.partitionBy(key).orderBy(*blocks)  # one small row per block of a key
        while True:
            states = result.drop("marks")
            linked = states.withColumns({f"w_{c}": F.lag(f"e_{c}").over(order) for c in state})
            same = F.lit(True)
            for c in state:
                same = same & F.col(f"s_{c}").eqNullSafe(F.col(f"w_{c}"))
            stale = linked.filter(~same).select(*group, *[F.col(f"w_{c}").alias(f"s_{c}") for c in state])
            if stale.isEmpty():
                break
            stale = cut_lineage(stale)
            again = walk(rows.join(stale, group))
            result = cut_lineage(result.join(stale.select(*group), group, "left_anti").unionByName(again))
    marks = result.select(key, F.inline("marks")).withColumnRenamed("tie", tie)
    return df.join(marks, [key, tie])


def anchor_fixes(df: DataFrame, min_gap_ms: int = 600_000, min_dist_m: float = 200.0,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keep the first and last fix and every fix far enough, in time and space, from the last kept one.

    Paths of at most three fixes are kept whole.
    """

    def step(pdf, start):
        last, marks = start, []
        for lon, lat, t in zip(pdf["lon"], pdf["lat"], pdf["t_ms"]):
            keep = last is None or (t - last["t"] >= min_gap_ms
                                    and _earth(last["lon"], last["lat"], lon, lat) >= min_dist_m)
            if keep:
                last = {"lon": float(lon), "lat": float(lat), "t": float(t)}
            marks.append(bool(keep))
        return marks, last

    marked = chained(df, "user_id", "t_ms", "point_id", ["lon", "lat"], step, ["lon", "lat", "t"], T.BooleanType(), block_rows)
    ends = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("t_ms", "point_id")).alias("_last"))
    rows = marked.join(ends, "user_id")
    is_last = F.struct("t_ms", "point_id") == F.col("_last")
    return rows.filter(F.col("mark") | is_last | (F.col("_n") <= 3)).drop("mark", "_n", "_last")


def static_clusters(df: DataFrame, key: str, radius_m: float = 50.0, time: str = "t_ms", tie: str = "point_id",
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Merge consecutive fixes that stay within ``radius_m`` of their running mean position.

    Medians of height and time are taken per cluster; callers hand in at most a few dozen
    sampled origins per key.
    """
    if radius_m <= 0:
        return df.select(key, F.col(tie).cast("long").alias("cluster"), "lon", "lat", "z",
                         F.col(time).alias("t_ms"), F.lit(1).cast("long").alias("size"))

    def step(pdf, start):
        c, marks = start, []
        for i, lon, lat in zip(pdf[tie], pdf["lon"], pdf["lat"]):
            if c is not None:
                shrink = np.cos(np.radians((c["lat"] + lat) / 2))
                d = float(np.hypot((lon - c["lon"]) * 111_000.0 * shrink, (lat - c["lat"]) * 111_000.0))
            if c is not None and d <= radius_m:
                n = c["n"] + 1
                c = {**c, "lon": c["lon"] + (lon - c["lon"]) / n, "lat": c["lat"] + (lat - c["lat"]) / n, "n": n}
            else:  # states are doubles, so the first row's number travels as two halves
                c = {"lon": float(lon), "lat": float(lat), "n": 1.0, "hi": float(int(i) >> 32), "lo": float(int(i) & 0xFFFFFFFF)}
            marks.append((int(c["hi"]) << 32) | int(c["lo"]))
        return marks, c

    marked = chained(df, key, time, tie, ["lon", "lat"], step, ["lon", "lat", "n", "hi", "lo"], T.LongType(), block_rows)
    return marked.groupBy(key, F.col("mark").alias("cluster")).agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.percentile("z", F.lit(0.5)).alias("z"),
        F.percentile(time, F.lit(0.5)).cast("long").alias("t_ms"), F.count(F.lit(1)).alias("size"))


def thin_circles(df: DataFrame, share: float = 0.15, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keep a circle when its centre moved more than ``share`` of its own radius since the last kept one."""

    def step(pdf, start):
        last, marks = start, []
        for lon, lat, r in zip(pdf["lon"], pdf["lat"], pdf["radius_m"]):
            keep = last is None or _earth(last["lon"], last["lat"], lon, lat) > share * r
            if keep:
                last = {"lon": float(lon), "lat": float(lat)}
            marks.append(bool(keep))
        return marks, last

    marked = chained(df, "user_id", "t_ms", "point_id", ["lon", "lat", "radius_m"], step, ["lon", "lat"], T.BooleanType(), block_rows)
    return marked.filter("mark").drop("mark")
