"""Encounters of moving persons, and misses: the same place at another time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.geo import GRID_M_PER_DEG
from chronoweave.operators.sequence import Timeline, union_all
from chronoweave.operators.skew import broadcast_if_small, hot_keys
from chronoweave.operators.trajectory import segments
from chronoweave.session import cut_lineage, ship_package

#: Rows of one (time slot, cell) above which it is opened into smaller ones.
CROWDED = 20_000
#: A slot is opened into so many, a cell into two by two.
SLOTS = 4
#: Shorter slots, in milliseconds, are not opened.
LEAST_SLOT_MS = 1_000
#: Degrees by which listings reach further than they must, against rounding.
SLACK = 1e-9


def motions(df: DataFrame, max_gap_ms: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Straight, even motion from each fix to the user's next: ``seg, user_id, t0, t1, x0, y0, x1, y1`` (degrees, milliseconds).

    Fixes farther apart in time than ``max_gap_ms`` say nothing about the way between them. A user's single fix is no motion.
    """
    s = segments(df.select("point_id", "user_id", "t_ms", "lon", "lat"), hot_rows=hot_rows)
    out = s.select(F.col("point_id").alias("seg"), "user_id", F.col("t_ms").alias("t0"), F.col("next_t_ms").alias("t1"), F.col("lon").alias("x0"),
                   F.col("lat").alias("y0"), F.col("next_lon").alias("x1"), F.col("next_lat").alias("y1"))
    return out if max_gap_ms is None else out.filter(F.col("t1") - F.col("t0") <= max_gap_ms)


def _shrink(p: str = "") -> Column:
    """Metres in a degree of longitude, at the middle of a motion, over those of latitude."""
    return F.greatest(F.cos(F.radians((F.col(f"{p}y0") + F.col(f"{p}y1")) / 2)), F.lit(0.01))


def _at(t: Column, a: str, b: str) -> Column:
    """Coordinate at an instant of a motion."""
    share = F.coalesce((t - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0)), F.lit(0.0))
    return F.col(a) + (F.col(b) - F.col(a)) * share


def _listed(rows: DataFrame, level: int, slot_ms: int, cell_deg: float, reach_m: float) -> DataFrame:
    """Each motion once for every (slot, cell) of a level that its part in the slot touches; in the role ``near`` also those within reach.

    Rows that come from a crowded bucket stay inside it.
    """
    slot, cell = F.lit(float(slot_ms) / SLOTS ** level), F.lit(cell_deg / 2 ** level)
    own = F.sequence(F.floor(F.col("t0") / slot), F.floor(F.col("t1") / slot))
    if level:
        own = F.sequence(F.greatest(F.floor(F.col("t0") / slot), F.col("slot") * SLOTS), F.least(F.floor(F.col("t1") / slot), F.col("slot") * SLOTS + SLOTS - 1))
        rows = rows.withColumnsRenamed({"cx": "_px", "cy": "_py"}).filter(F.floor(F.col("t0") / slot) <= F.col("slot") * SLOTS + SLOTS - 1)
    out = rows.withColumn("slot", F.explode(own))
    start, stop = F.greatest(F.col("t0").cast("double"), F.col("slot") * slot), F.least(F.col("t1").cast("double"), (F.col("slot") + 1) * slot)
    more = F.when(F.col("near"), F.lit(reach_m / GRID_M_PER_DEG)).otherwise(0.0)
    out = out.withColumns({"_xa": _at(start, "x0", "x1"), "_xb": _at(stop, "x0", "x1"), "_ya": _at(start, "y0", "y1"), "_yb": _at(stop, "y0", "y1")})
    spans = {}
    for axis, by in (("x", more / _shrink()), ("y", more)):
        low = F.floor((F.least(f"_{axis}a", f"_{axis}b") - by - SLACK) / cell)
        high = F.floor((F.greatest(f"_{axis}a", f"_{axis}b") + by + SLACK) / cell)
        if level:
            low, high = F.greatest(low, F.col(f"_p{axis}") * 2), F.least(high, F.col(f"_p{axis}") * 2 + 1)
        spans[axis] = (low, high)
    out = out.withColumns({f"_{k}{axis}": v for axis, span in spans.items() for k, v in zip("lh", span, strict=True)}).filter("_lx <= _hx and _ly <= _hy")
    out = out.withColumn("cx", F.explode(F.sequence("_lx", "_hx"))).withColumn("cy", F.explode(F.sequence("_ly", "_hy")))
    return out.select("seg", "user_id", "t0", "t1", "x0", "y0", "x1", "y1", "near", F.lit(level).alias("level"), "slot", "cx", "cy")


BUCKET = ["level", "slot", "cx", "cy"]


def buckets(moves: DataFrame, reach_m: float, slot_ms: int, cell_m: float, crowded: int = CROWDED) -> DataFrame:
    """Every motion twice (``near``: reaching out, or not) in the buckets of time and space it touches, crowded ones opened.

    A bucket is opened until it has at most ``crowded`` rows, or a slot of under a second's length. No bucket is dropped.
    """
    cell_deg = cell_m / GRID_M_PER_DEG
    roles = moves.withColumn("near", F.explode(F.array(F.lit(True), F.lit(False))))
    now, level, done = _listed(roles, 0, slot_ms, cell_deg, reach_m), 0, []
    while True:
        full = cut_lineage(now.groupBy(*BUCKET).count().filter(F.col("count") > crowded).select(*BUCKET))
        if slot_ms / SLOTS ** (level + 1) < LEAST_SLOT_MS or full.isEmpty():
            return union_all([*done, now])
        marked = now.join(broadcast_if_small(full.withColumn("_full", F.lit(True))), BUCKET, "left")
        done.append(marked.filter("_full is null").drop("_full"))
        level += 1
        now = cut_lineage(_listed(marked.filter("_full").drop("_full", "level"), level, slot_ms, cell_deg, reach_m))


#: Slots and cells along a side that a task takes at once: a motion travels in buckets of so many, and is listed in each inside the task.
LONG, WIDE = 24, 8
#: Rows of such a bucket above which it is opened into smaller ones.
TASK_ROWS = 100_000
#: Pairs of motions looked at together.
CHUNK = 500_000
#: Motions whose slots and cells are listed together.
LISTED = 5_000


def approaches(moves: DataFrame, reach_m: float, slot_ms: int = 1_800_000, cell_m: float | None = None, crowded: int = TASK_ROWS,
               hot_rows: int | None = None) -> DataFrame:
    """Pairs of motions of different users that come within ``reach_m``, each once: ``user_a < user_b``, when, where and how near.

    While both motions last, their distance is the length of a vector that changes evenly, so its least value and the time within reach are
    roots of a quadratic. Distances are measured on the plane at the middle latitude of ``user_a``'s motion. A pair of motions is
    reported in the bucket that holds ``user_b`` at the nearest instant, and in no other that both are listed in.

    Motions travel in wide buckets, a few rows each, and are listed in slots and cells only inside the task that has them; no pair is
    shuffled. A bucket of one instant that cannot be opened is dealt to several tasks as blocks of its rows.
    """
    cell_m = cell_m or max(4 * reach_m, 500.0)
    ship_package(moves.sparkSession)
    ends = ["seg", "user_id", "t0", "t1", "x0", "y0", "x1", "y1"]
    own = cut_lineage(moves.select(*ends).filter("user_id is not null"))
    listed = buckets(own, reach_m, slot_ms * LONG, cell_m * WIDE, crowded)
    hot, _ = hot_keys(listed, BUCKET, crowded if hot_rows is None else hot_rows)
    if hot is None:
        listed = listed.withColumn("_block", F.lit(0))
    else:
        parts = F.coalesce(F.col("_parts"), F.lit(1))
        mine = F.pmod(F.xxhash64(*ends), parts).cast("int")
        every = F.sequence(F.lit(0), parts - 1)
        # a block is a part of those who reach out with a part of those who are reached
        blocks = F.when(F.col("near"), F.transform(every, lambda i: mine * parts + i)).otherwise(F.transform(every, lambda i: i * parts + mine))
        listed = listed.join(broadcast_if_small(hot), BUCKET, "left").withColumn("_block", F.explode(blocks)).drop("_parts")
    found = T.StructType([T.StructField(n, own.schema[c].dataType) for n, c in (("user_a", "user_id"), ("user_b", "user_id"), ("seg_a", "seg"), ("seg_b", "seg"))]
                         + [T.StructField(n, T.DoubleType()) for n in ("enter_ms", "leave_ms", "closest_m", "closest_ms", "lon", "lat")])
    slot, cell = float(slot_ms * LONG), cell_m * WIDE / GRID_M_PER_DEG

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _meet(pa.Table.from_batches(list(batches)), reach_m, slot, cell, found.names)

    # pairs, not bytes, are the work of a task: the number of tasks does not follow the size of the rows
    spark = own.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return listed.withColumn("_k", _shrink()).repartition(tasks, *BUCKET, "_block").groupBy(*BUCKET, "_block").applyInArrow(run, found)


def _bins(value: np.ndarray, low: float, size: float, many: int) -> np.ndarray:
    """Slots or cells of a bucket, those beyond its borders in the first or last."""
    return np.nan_to_num(np.clip(np.floor((value - low) / size), 0, many - 1)).astype(np.int64)


def _spread(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place within it of ``many`` places a row."""
    return np.repeat(np.arange(len(many)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _meet(table: pa.Table, reach_m: float, slot: float, cell: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The approaches of one bucket: its motions are listed in ``LONG`` slots and at most ``WIDE`` by ``WIDE`` cells, and met there."""
    level, at, cx, cy = (table[c][0].as_py() for c in BUCKET)
    slot, cell = slot / SLOTS ** level, cell / 2 ** level
    # cells of twice the reach at least, whatever the bucket's size
    wide = max(1, min(WIDE, int(cell * GRID_M_PER_DEG / (2 * reach_m)))) if reach_m > 0 else WIDE
    t_low, x_low, y_low, t_step, step = at * slot, cx * cell, cy * cell, slot / LONG, cell / wide
    t0, t1, x0, y0, x1, y1, k = (table[c].to_numpy() for c in ("t0", "t1", "x0", "y0", "x1", "y1", "_k"))
    near = table["near"].to_numpy()
    users = table["user_id"].combine_chunks()
    rank = pc.rank(users, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    lasts = np.where(t1 > t0, t1 - t0, 1)
    vx, vy = np.where(t1 > t0, (x1 - x0) / lasts, 0.0), np.where(t1 > t0, (y1 - y0) / lasts, 0.0)

    def listing(rows: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Each of the rows once for every (slot, cell) that its part in the slot touches, with what is within reach."""
        first, last = (_bins(t[rows], t_low, t_step, LONG) for t in (t0, t1))
        which, i = _spread(last - first + 1)
        row, i = rows[which], i + first[which]
        start, stop = np.maximum(t0[row], t_low + i * t_step), np.minimum(t1[row], t_low + (i + 1) * t_step)
        spans = []
        for p, v, low, more in ((x0, vx, x_low, reach / GRID_M_PER_DEG / k[row]), (y0, vy, y_low, reach / GRID_M_PER_DEG)):
            a, b = p[row] + v[row] * (start - t0[row]), p[row] + v[row] * (stop - t0[row])
            spans += [np.floor((np.minimum(a, b) - more - SLACK - low) / step), np.floor((np.maximum(a, b) + more + SLACK - low) / step)]
        with np.errstate(invalid="ignore"):
            inside = (spans[1] >= 0) & (spans[0] < wide) & (spans[3] >= 0) & (spans[2] < wide)
        lx, hx, ly, hy = (np.clip(s[inside], 0, wide - 1).astype(np.int64) for s in spans)
        broad = hx - lx + 1
        which, j = _spread(broad * (hy - ly + 1))
        place = (i[inside][which] * wide + lx[which] + j % broad[which]) * wide + ly[which] + j // broad[which]
        return row[inside][which], place

    two, at_two = listing(np.flatnonzero(~near), 0.0)
    order = np.argsort(at_two, kind="stable")
    two, at_two = two[order], at_two[order]

    def candidates() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Motions that share a slot and cell, and which: few enough at a time."""
        reaching = np.flatnonzero(near)
        for start in range(0, len(reaching), LISTED):
            one, at_one = listing(reaching[start:start + LISTED], reach_m)
            first = np.searchsorted(at_two, at_one)
            many = np.searchsorted(at_two, at_one, side="right") - first
            edge = np.concatenate([[0], np.cumsum(many)])
            low = 0
            while low < len(one):
                high = max(low + 1, int(np.searchsorted(edge, edge[low] + CHUNK, side="right")) - 1)
                which, j = _spread(many[low:high])
                yield one[low:high][which], two[first[low:high][which] + j], at_one[low:high][which]
                low = high

    for a, b, place in candidates():
        keep = (rank[a] < rank[b]) & (t0[a] <= t1[b]) & (t0[b] <= t1[a])
        a, b, place = a[keep], b[keep], place[keep]
        s, e = np.maximum(t0[a], t0[b]), np.minimum(t1[a], t1[b])
        m = k[a] * GRID_M_PER_DEG
        rx = ((x0[b] + vx[b] * (s - t0[b])) - (x0[a] + vx[a] * (s - t0[a]))) * m
        ry = ((y0[b] + vy[b] * (s - t0[b])) - (y0[a] + vy[a] * (s - t0[a]))) * GRID_M_PER_DEG
        wx, wy = (vx[b] - vx[a]) * m, (vy[b] - vy[a]) * GRID_M_PER_DEG
        q2, q1, span = wx * wx + wy * wy, rx * wx + ry * wy, (e - s).astype(float)
        still = q2 == 0
        by = np.where(still, 1.0, q2)
        when = np.maximum(0.0, np.minimum(span, np.where(still, 0.0, -q1 / by)))
        dx, dy = rx + wx * when, ry + wy * when
        d2, t = dx * dx + dy * dy, s + when
        x, y = x0[b] + vx[b] * (t - t0[b]), y0[b] + vy[b] * (t - t0[b])
        here = (np.floor(t / slot) == at) & (np.floor(x / cell) == cx) & (np.floor(y / cell) == cy)
        here &= (_bins(t, t_low, t_step, LONG) * wide + _bins(x, x_low, step, wide)) * wide + _bins(y, y_low, step, wide) == place
        pick = np.flatnonzero((d2 <= reach_m * reach_m) & here)
        if not len(pick):
            continue
        a, b, s, e, t, when, span, still, by = (c[pick] for c in (a, b, s, e, t, when, span, still, by))
        q0 = rx[pick] * rx[pick] + ry[pick] * ry[pick]
        q1, q2 = q1[pick], q2[pick]
        root = np.sqrt(np.maximum(0.0, q1 * q1 - q2 * (q0 - reach_m * reach_m)))
        enter, leave = (-q1 - root) / by, (-q1 + root) / by
        ids = [table[c].combine_chunks() for c in ("user_id", "seg")]
        yield pa.RecordBatch.from_arrays(
            [ids[0].take(pa.array(a)), ids[0].take(pa.array(b)), ids[1].take(pa.array(a)), ids[1].take(pa.array(b)),
             *[pa.array(c) for c in (np.where(still | (enter <= 0), s.astype(float), s + np.minimum(enter, when)),
                                     np.where(still | (leave >= span), e.astype(float), s + np.maximum(leave, when)), np.sqrt(d2[pick]), t, x[pick], y[pick])]], names=names)


def encounters(met: DataFrame, meeting_m: float | None, hot_rows: int | None = None) -> DataFrame:
    """Uninterrupted times that two users are within reach: ``user_a, user_b, start_ms, end_ms, closest_m, closest_ms, lon, lat, kind``.

    ``met``: rows of ``approaches``. Times that touch are one. ``kind`` is ``meeting`` where they come as near as ``meeting_m``, else ``near``.
    Without ``meeting_m`` only the users and times are told, and only they are needed.
    """
    pair, place = ["user_a", "user_b"], [] if meeting_m is None else ["closest_m", "closest_ms", "lon", "lat"]
    nearest = F.min(F.struct(*place or [F.lit(0).alias("_")]))
    met = met.select(*pair, "enter_ms", "leave_ms", *place)
    # rows of a pair stay together from the first step to the last, unless they are too many
    cold = hot_keys(met, pair, hot_rows)[0] is None
    if cold:
        met = met.repartition(*pair)
    # one row an entry, so that entries have one order
    each = met.groupBy("user_a", "user_b", "enter_ms").agg(F.max("leave_ms").alias("leave_ms"), nearest.alias("_near"), F.lit(0).alias("_tie"))
    line = Timeline(each, pair, "enter_ms", "_tie", hot_rows, cold).prior_max(_before=F.col("leave_ms"))
    fresh = F.coalesce(F.col("enter_ms") > F.col("_before"), F.lit(True)).cast("int")
    runs = line.adding(_fresh=fresh).running(_run=F.col("_fresh")).result()
    out = runs.groupBy("user_a", "user_b", "_run").agg(F.min("enter_ms").alias("start_ms"), F.max("leave_ms").alias("end_ms"), F.min("_near").alias("_n"))
    if meeting_m is None:
        return out.select("user_a", "user_b", "start_ms", "end_ms")
    return out.select("user_a", "user_b", "start_ms", "end_ms", "_n.*", F.when(F.col("_n.closest_m") <= meeting_m, "meeting").otherwise("near").alias("kind"))


# ---------------------------------------------------------------- visits and misses

def visits(df: DataFrame, place: Column, hot_rows: int | None = None) -> DataFrame:
    """Stretches of consecutive fixes of a user in one place: ``place, user_id, visit`` (its first fix), ``arrive_ms, leave_ms, fixes``."""
    own = df.select("point_id", "user_id", "t_ms", place.alias("place"))
    line = Timeline(own, ["user_id"], "t_ms", "point_id", hot_rows).neighbours(previous={"_place": F.col("place")})
    line = line.adding(_moved=(~F.col("place").eqNullSafe(F.col("_place"))).cast("int")).running(_stay=F.col("_moved"))
    first = F.min_by("point_id", F.struct("t_ms", "point_id"))
    return (line.result().filter("place is not null").groupBy("user_id", "_stay")
            .agg(F.first("place").alias("place"), first.alias("visit"), F.min("t_ms").alias("arrive_ms"), F.max("t_ms").alias("leave_ms"), F.count(F.lit(1)).alias("fixes"))
            .drop("_stay"))


def temporal_misses(seen: DataFrame, max_gap_ms: int, hot_rows: int | None = None) -> DataFrame:
    """For each visit the next arrival of somebody else in the same place after it, at most ``max_gap_ms`` later.

    ``seen``: rows of ``visits``. An as-of join: departures and arrivals of a place stand in one order, read from its end, and each
    departure looks up the arrival before it there; were that the user's own, the first of another user behind it. ``place,
    user_id, visit, leave_ms, next_user, next_visit, next_ms, gap_s``. Arrivals at the very instant of a departure are no misses, of
    several at one instant the smallest visit counts. A popular place is ordered in blocks.
    """
    arrivals = Timeline(seen, ["place"], "arrive_ms", "visit", hot_rows).neighbours(previous={"_who": F.col("user_id")}).result()
    # the least (time, visit) among what follows is the greatest of the negated ones read from the end
    mark = F.struct((-F.col("arrive_ms")).alias("t"), (-F.col("visit")).alias("visit"), F.col("user_id").alias("who"))
    back = arrivals.withColumns({"_t": -2 * F.col("arrive_ms"), "_i": -F.col("visit"), "_mark": mark})
    starts = F.when(~F.col("user_id").eqNullSafe(F.col("_who")), F.col("_mark"))
    known = Timeline(back, ["place"], "_t", "_i", hot_rows).prior_max(_other=starts).result()
    keep = ["place", "user_id", "visit", "leave_ms", "_i"]
    arrive = known.select(*keep, "_t", F.lit(True).alias("_arrival"), F.struct("_mark.*", F.col("_other").alias("other")).alias("_mark"))
    # read from the end, a departure comes before the arrivals of its instant
    leave = known.select(*keep, (-2 * F.col("leave_ms") - 1).alias("_t"), F.lit(False).alias("_arrival"), F.lit(None).cast(arrive.schema["_mark"].dataType).alias("_mark"))
    line = Timeline(arrive.unionByName(leave), ["place"], "_t", "_i", hot_rows).prior_max(_next=F.col("_mark"))
    n = F.col("_next")
    mine = n["who"] == F.col("user_id")
    found = line.result().filter("not _arrival and _next is not null").select(
        "place", "user_id", "visit", "leave_ms", F.when(mine, n["other"]["who"]).otherwise(n["who"]).alias("next_user"),
        (-F.when(mine, n["other"]["visit"]).otherwise(n["visit"])).alias("next_visit"), (-F.when(mine, n["other"]["t"]).otherwise(n["t"])).alias("next_ms"))
    gap = F.col("next_ms") - F.col("leave_ms")
    return found.filter(gap <= max_gap_ms).withColumn("gap_s", gap / 1000)
