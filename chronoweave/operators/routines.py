"""Groups that stay together, and the repeated structure of persons' days."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.time import DAY_MS
from chronoweave.operators import groups
from chronoweave.operators.components import connected
from chronoweave.operators.sequence import Timeline
from chronoweave.operators.skew import broadcast_if_small, hot_keys, lookup_join
from chronoweave.session import cut_lineage, ship_package, stored


# ---------------------------------------------------------------- bundles

#: A slot of time is so many times as long as an encounter, on average.
LENGTHS = 4
#: It is shorter where more encounters than these would begin in it.
SLOT_ROWS = 250_000


def bundles(met: DataFrame, min_members: int = 3, min_ms: int = 0, slot_ms: int = 900_000, hot_rows: int | None = None) -> DataFrame:
    """Groups that stay together: ``members`` (in order), ``size, start_ms, end_ms``.

    ``met``: rows of ``encounters`` (``user_a, user_b, start_ms, end_ms``). At an instant, a group is what its encounters connect; a bundle
    is the longest stretch in which a group has the same members. Time is cut into slots, of ``slot_ms`` at least and otherwise several times
    as long as an encounter lasts, so that few encounters are in more than one; a task sweeps a slot, and no encounter is listed for the
    stretches between others' beginnings and endings. Stretches with equal members that touch at a slot's border are one bundle.
    """
    ship_package(met.sparkSession)
    own = met.select("user_a", "user_b", F.round("start_ms").cast("long").alias("_from"), F.round("end_ms").cast("long").alias("_to"))
    own = stored(own.filter("_from < _to and user_a is not null and user_b is not null"), "own")
    budget = max(SLOT_ROWS if hot_rows is None else hot_rows, 1)
    known = own.agg(F.avg(F.col("_to") - F.col("_from")).alias("lasting"), F.count(F.lit(1)).alias("rows"), (F.max("_to") - F.min("_from")).alias("span")).first()
    wide = min(LENGTHS * (known["lasting"] or 0), (known["span"] or 0) * budget / max(known["rows"], 1))
    slot_ms = slot_ms * max(round(wide / slot_ms), 1)
    begin, end = F.col("slot") * slot_ms, (F.col("slot") + 1) * slot_ms
    slots = F.sequence(F.floor(F.col("_from") / slot_ms), F.floor((F.col("_to") - 1) / slot_ms))
    own = own.withColumn("slot", F.explode(slots)).withColumns({"_from": F.greatest("_from", begin), "_to": F.least("_to", end)})
    own = _thinned(own, (F.col("_from") == begin) & (F.col("_to") == end), hot_rows)
    found = T.StructType([T.StructField("members", T.ArrayType(own.schema["user_a"].dataType)), T.StructField("start_ms", T.LongType()),
                          T.StructField("end_ms", T.LongType()), T.StructField("open", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        start = table["slot"][0].as_py() * slot_ms
        yield from groups.groups(table, start, start + slot_ms, min_members, min_ms, found.names)

    # changes, not bytes, are the work of a task
    spark = own.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # a group is as long as its result: one row with its members
    sets = stored(own.repartition(tasks, "slot").groupBy("slot").applyInArrow(run, found), "sets")
    line = Timeline(sets.filter("open").drop("open"), ["members"], "start_ms", "end_ms", hot_rows).neighbours(previous={"_ended": F.col("end_ms")})
    line = line.adding(_fresh=F.coalesce(F.col("_ended") < F.col("start_ms"), F.lit(True)).cast("int")).running(_run=F.col("_fresh"))
    out = line.result().groupBy("members", "_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_run")
    out = out.unionByName(sets.filter("not open").drop("open"))
    return out.filter(F.col("end_ms") - F.col("start_ms") >= min_ms).select("members", F.size("members").alias("size"), "start_ms", "end_ms")


def _thinned(own: DataFrame, lasting: Column, hot_rows: int | None) -> DataFrame:
    """In slots with very many encounters, those that last throughout are replaced by fewer that connect the same users.

    Parts of them are taken apart from each other, and each leaves no more than there are users.
    """
    hot, _ = hot_keys(own, ["slot"], hot_rows)
    if hot is None:
        return own
    marked = own.join(broadcast_if_small(hot), "slot", "left").withColumn("_thin", lasting & F.col("_parts").isNotNull())
    thin = marked.filter("_thin").withColumn("_part", F.pmod(F.xxhash64("user_a"), F.col("_parts")))
    names = ["user_a", "user_b", "slot", "_from", "_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from groups.stars(pa.Table.from_batches(list(batches)), names)

    few = thin.select(*names, "_part").groupBy("slot", "_part").applyInArrow(run, T.StructType([own.schema[c] for c in names]))
    return marked.filter("not _thin").select(*names).unionByName(few)


# ---------------------------------------------------------------- days

def sessions(df: DataFrame, gap_ms: int) -> DataFrame:
    """Activity of a user without a pause of ``gap_ms``: ``user_id, start_ms, end_ms, lon, lat`` (means), ``fixes``."""
    timed = df.withColumn("_at", F.timestamp_millis("t_ms"))
    return timed.groupBy("user_id", F.session_window("_at", f"{gap_ms} milliseconds")).agg(
        F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
        F.count(F.lit(1)).alias("fixes")).drop("session_window")


def stations(stays: DataFrame, cell_deg: float, min_stays: int, hot_rows: int | None = None) -> DataFrame:
    """Adds ``station`` to each stay: the dense places of a user, named by their least cell (struct ``cx, cy``); null elsewhere.

    Cells of a grid with at least ``min_stays`` of the user's stays are cores. Cores that touch, corners too, are one station; another cell
    belongs to the least station that it touches.
    """
    cell = {"cx": F.floor(F.col("lon") / cell_deg), "cy": F.floor(F.col("lat") / cell_deg)}
    own = cut_lineage(stays.withColumns(cell))
    cells = own.groupBy("user_id", "cx", "cy").count()
    cores = cells.filter(F.col("count") >= min_stays).drop("count")
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = cores.select("user_id", F.col("cx").alias("_x"), F.col("cy").alias("_y"), F.explode(around).alias("_d")).withColumns({
        "cx": F.col("_x") + F.col("_d.dx"), "cy": F.col("_y") + F.col("_d.dy")}).drop("_d")
    node = lambda x, y: F.struct("user_id", F.col(x).alias("cx"), F.col(y).alias("cy"))
    linked = connected(near.join(cores, ["user_id", "cx", "cy"]).select(node("_x", "_y").alias("a"), node("cx", "cy").alias("b")), hot_rows)
    named = linked.select("node.*", F.struct("component.cx", "component.cy").alias("station"))
    # every cell by the cores on or around it; its own station if it is one
    reached = near.join(named.toDF("user_id", "_x", "_y", "station"), ["user_id", "_x", "_y"])
    mine = F.struct(((F.col("_x") != F.col("cx")) | (F.col("_y") != F.col("cy"))).alias("other"), "station")
    best = reached.groupBy("user_id", "cx", "cy").agg(F.min(mine).alias("_m")).select("user_id", "cx", "cy", "_m.station")
    return lookup_join(own, best, ["user_id", "cx", "cy"], "left", hot_rows=hot_rows).drop("cx", "cy")


def day_sequences(stays: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``user_id, day, sequence``: a day's stations in order, each once as long as it lasts; stays without one are left out.

    A day has no more stays than pauses of the session length fit in.
    """
    at = stays.filter("station is not null").withColumns({"day": F.floor(F.col("start_ms") / DAY_MS), "_tie": F.lit(0)})
    line = Timeline(at, ["user_id", "day"], "start_ms", "_tie", hot_rows).neighbours(previous={"_before": F.col("station")})
    moved = line.result().filter(~F.col("station").eqNullSafe(F.col("_before")))
    ordered = F.array_sort(F.collect_list(F.struct("start_ms", "station")))
    return moved.groupBy("user_id", "day").agg(F.transform(ordered, lambda s: s["station"]).alias("sequence"))


def routines(days: DataFrame) -> DataFrame:
    """``user_id, sequence, days, share``: on how many of the user's days each sequence of stations occurs."""
    counted = days.groupBy("user_id", "sequence").agg(F.count(F.lit(1)).alias("days"))
    return counted.withColumn("share", F.col("days") / F.sum("days").over(Window.partitionBy("user_id")))


def transitions(days: DataFrame) -> DataFrame:
    """``user_id, from, to, count``: moves from station to station within days."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("sequence") - 1), lambda i: F.struct(
        F.element_at("sequence", i).alias("from"), F.element_at("sequence", i + 1).alias("to")))
    moves = days.filter(F.size("sequence") > 1).select("user_id", F.explode(pairs).alias("m")).select("user_id", "m.*")
    return moves.groupBy("user_id", "from", "to").agg(F.count(F.lit(1)).alias("count"))
