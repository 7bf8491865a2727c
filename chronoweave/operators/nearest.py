"""Nearest item per point, without listing the pairs of a crowded place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.sequence import union_all
from chronoweave.operators.skew import lookup_join, spread
from chronoweave.session import cut_lineage

LEAF = 64  # items an index cell may hold
MAX_DEPTH = 40
STRIDE = 2  # quadtree levels per step
WALK_LEAF = 8  # items left to compare at the bottom of the quadtree


def nearest(points: DataFrame, items: DataFrame, by: list[str], point_id: str, item_id: str,
            xy: tuple[str, str] = ("x", "y"), item_xy: tuple[str, str] = ("x", "y"),
            hot_rows: int | None = None) -> DataFrame:
    """Add ``hit`` (the nearest item's columns and ``d2``) to every point; null when its ``by`` group is empty.

    Distance is planar in the units of the coordinates; ties go to the lowest ``item_id``.

    Items at one spot collapse to one. A grid sized from each group's own item density then answers nearly
    every point with one lookup: a cell's bounded list holds the items of the 3x3 cells around
    it, and an answer no farther than one cell side is final. Points in sparse or over-full
    places walk down a quadtree, keeping only the cells that can still hold the nearest item.
    """
    ix, iy = item_xy
    keep = [c for c in items.columns if c not in by]
    spots = items.groupBy(*by, ix, iy).agg(F.min_by(F.struct(*keep), F.col(item_id)).alias("item"))
    # The index is used by several branches below; writing it keeps them consistent and cheap.
    spots = cut_lineage(spots.withColumnsRenamed({ix: "_ix", iy: "_iy"}))
    groups = spots.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_ix").alias("x0"), F.max("_ix").alias("x1"),
                                    F.min("_iy").alias("y0"), F.max("_iy").alias("y1"))
    box = groups.agg(F.max("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
                     F.min("y0").alias("y0"), F.max("y1").alias("y1")).first()
    if not box["n"]:
        return points.withColumn("hit", F.lit(None).cast(_hit_type(spots)))
    side = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-12)
    # every group has cells of its own, by how densely its items lie in its own box
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-12))
    area = F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), wide * wide * 1e-6)
    sizes = groups.select(*by, F.col("x0").alias("_x0"), F.col("y0").alias("_y0"), F.greatest(1.5 * F.sqrt(area / F.col("n")), wide * 1e-6).alias("_cell"))
    sizes = cut_lineage(sizes)

    def placed(df: DataFrame) -> DataFrame:
        return lookup_join(df, sizes, by, "left", hot_rows=hot_rows) if by else df.crossJoin(F.broadcast(sizes))  # one row

    laid = cut_lineage(placed(spots))
    done: list[DataFrame] = []
    rest = placed(spread(points))
    for times in (1, 4):  # a second, wider look settles points in uneven layouts
        tried = cut_lineage(_look(rest, laid, by, item_id, xy, times, hot_rows))
        reach = F.col("_cell") * times
        sure = F.coalesce(~F.col("_full") & (F.col("hit")["d2"] <= reach * reach), F.lit(False))
        done.append(tried.filter(sure).drop("_full", "_x0", "_y0", "_cell"))
        rest = tried.filter(~sure).drop("_full", "hit")
        if rest.isEmpty():
            return union_all(done)
    rest = rest.drop("_x0", "_y0", "_cell")
    walked = _walk(rest, spots, by, point_id, item_id, xy, box, side)
    # points of a group without items come out of the walk with nothing
    return union_all([*done, rest.join(walked.select(point_id, "hit"), point_id, "left")])


def _look(points: DataFrame, spots: DataFrame, by: list[str], item_id: str, xy: tuple[str, str], times: int, hot_rows: int | None) -> DataFrame:
    """Best item among the 3x3 cells around each point (``hit``), and whether a cell there was over-full. Cells are ``times`` as
    wide as the group's own."""

    def cell_of(x: Column, y: Column) -> dict[str, Column]:
        return {"_cx": F.floor((x - F.col("_x0")) / (F.col("_cell") * times)), "_cy": F.floor((y - F.col("_y0")) / (F.col("_cell") * times))}

    keyed = spots.withColumns(cell_of(F.col("_ix"), F.col("_iy")))
    entry = F.struct(F.col("_ix").alias("x"), F.col("_iy").alias("y"), F.col("item"))
    # lists exist only for cells within the bound; the others are marked and left to the quadtree
    sizes = keyed.groupBy(*by, "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    listed = (keyed.join(sizes.filter(F.col("_n") <= LEAF), [*by, "_cx", "_cy"], "left_semi")
              .groupBy(*by, "_cx", "_cy").agg(F.collect_list(entry).alias("_items"), F.lit(False).alias("_full")))
    over = sizes.filter(F.col("_n") > LEAF).select(
        *by, "_cx", "_cy", F.array().cast(listed.schema["_items"].dataType).alias("_items"), F.lit(True).alias("_full"))
    reach = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    around = (listed.unionByName(over).withColumn("_dx", F.explode(reach)).withColumn("_dy", F.explode(reach))
              .groupBy(*by, (F.col("_cx") + F.col("_dx")).alias("_cx"), (F.col("_cy") + F.col("_dy")).alias("_cy"))
              .agg(F.flatten(F.collect_list("_items")).alias("_items"), F.max("_full").alias("_full")))
    px, py = F.col(xy[0]), F.col(xy[1])
    met = lookup_join(points.withColumns(cell_of(px, py)), around, [*by, "_cx", "_cy"], "left", max_rows=50_000, hot_rows=hot_rows)
    return met.withColumn("hit", _best(F.col("_items"), px, py, item_id)).drop("_items", "_cx", "_cy")


def _hit_type(spots: DataFrame) -> str:
    return f"struct<d2:double,item:{spots.schema['item'].dataType.simpleString()}>"


def _best(entries: Column, px: Column, py: Column, item_id: str) -> Column:
    """Closest entry of a bounded list."""
    scored = F.transform(entries, lambda e: F.struct(
        (F.pow(px - e["x"], 2) + F.pow(py - e["y"], 2)).alias("d2"), e["item"][item_id].alias("id"),
        e["item"].alias("item")))
    top = F.array_min(scored)
    return F.when(top.isNotNull(), F.struct(top["d2"].alias("d2"), top["item"].alias("item")))


def _walk(points: DataFrame, spots: DataFrame, by: list[str], point_id: str, item_id: str,
          xy: tuple[str, str], box, side: float) -> DataFrame:
    """Level-by-level quadtree descent; the candidate cells of a point stay few at every level."""
    depth, width = 0, side * (1 + 1e-9)

    def at(level: int) -> dict[str, Column]:
        s = width / 2**level
        return {"_cx": F.floor((F.col("_ix") - box["x0"]) / s), "_cy": F.floor((F.col("_iy") - box["y0"]) / s)}

    while depth < MAX_DEPTH:
        top = spots.groupBy(*by, *[c.alias(n) for n, c in at(depth).items()]).count().agg(F.max("count")).first()[0]
        if top <= WALK_LEAF:
            break
        depth += STRIDE
    state = points.withColumn("_cand", F.array(F.struct(F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))))
    cols = points.columns
    for level in range(STRIDE, depth + 1, STRIDE):
        s = width / 2**level
        kids = (spots.select(*by, *[c.alias(n) for n, c in at(level).items()]).distinct()
                .groupBy(*by, F.shiftright("_cx", STRIDE).alias("cx"), F.shiftright("_cy", STRIDE).alias("cy"))
                .agg(F.collect_list(F.struct(F.col("_cx").alias("cx"), F.col("_cy").alias("cy"))).alias("_kids")))
        parents = state.select("*", F.inline("_cand")).drop("_cand")
        merged = (lookup_join(parents, kids, [*by, "cx", "cy"])
                  .groupBy(point_id).agg(F.first(F.struct(*cols)).alias("_row"), F.flatten(F.collect_list("_kids")).alias("_kids")))
        x, y = F.col("_row")[xy[0]], F.col("_row")[xy[1]]

        def gap(v: Column, lo: Column) -> Column:
            return F.greatest(lo - v, v - (lo + s), F.lit(0.0))

        def far(v: Column, lo: Column) -> Column:
            return F.greatest(F.abs(v - lo), F.abs(v - (lo + s)))

        def bounds(k: Column) -> Column:
            x0, y0 = k["cx"] * s + box["x0"], k["cy"] * s + box["y0"]
            return F.struct(k["cx"].alias("cx"), k["cy"].alias("cy"),
                            (F.pow(gap(x, x0), 2) + F.pow(gap(y, y0), 2)).alias("near"),
                            (F.pow(far(x, x0), 2) + F.pow(far(y, y0), 2)).alias("far"))

        merged = merged.withColumn("_b", F.transform("_kids", bounds))
        limit = F.array_min(F.transform("_b", lambda b: b["far"])) * (1 + 1e-9) + 1e-18
        merged = merged.withColumn("_limit", limit)
        state = merged.select("_row.*", F.transform(
            F.filter("_b", lambda b: b["near"] <= F.col("_limit")),
            lambda b: F.struct(b["cx"].alias("cx"), b["cy"].alias("cy"))).alias("_cand"))
        if level % (4 * STRIDE) == 0:
            state = cut_lineage(state)
    leaf = (spots.select(*by, *[c.alias(n) for n, c in zip(("cx", "cy"), at(depth).values())],
                         F.struct(F.col("_ix").alias("x"), F.col("_iy").alias("y"), "item").alias("e"))
            .groupBy(*by, "cx", "cy").agg(F.collect_list("e").alias("_items")))
    final = lookup_join(state.select("*", F.inline("_cand")).drop("_cand"), leaf, [*by, "cx", "cy"], "left")
    scored = final.withColumn("_h", _best(F.col("_items"), F.col(xy[0]), F.col(xy[1]), item_id))
    order = F.struct(F.col("_h")["d2"], F.col("_h")["item"][item_id])
    return scored.groupBy(point_id).agg(F.first(F.struct(*cols)).alias("_row"), F.min_by("_h", order).alias("hit")) \
        .select("_row.*", "hit")
