"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import written

WEIGHTS = (5, 2, 1)
#: How often a document may be taken.
REPEATS = 3
#: Hexadecimal digits of the shuffle key that cut each source into blocks, and blocks of finish times.
DIGITS = 3
SLOTS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _sources(sized: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """One row a source: its size, weight and target. The targets share all words by weight, none above ``repeats`` times
    its source: with the sources in order of cap over weight, those before the first whose cap holds its share are full."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "place")
    every = W.partitionBy()
    own = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("place", F.row_number().over(by_name))
           .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
           .withColumn("cap", F.col("source_size") * repeats))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    own = (own.withColumn("budget", F.sum("source_size").over(every))
           .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
           .withColumn("level", (F.col("budget") - F.col("full")).cast("double") / F.col("open")))
    holds = F.col("cap") / F.col("weight") >= F.col("level")
    level = F.min(F.when(holds, F.struct("cap_place", "level"))).over(every)["level"]
    return (own.withColumn("cap_place", F.row_number().over(by_cap)).withColumn("share", level)
            .select("source", "place", "source_size", "budget", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("share")).alias("target")))


def schedule(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Each source is shuffled by md5 of doc_id and queued ``repeats`` times; a copy's virtual finish time
    is the source's words up to its end over the target. All copies are range-sorted by finish time and
    the order is cut at the total budget; a copy that crosses its source's target is cut there. Running
    sums go over blocks (source and first digits of the key; slots of finish time) and then within one
    block, so no source is summed in one task. Null text has size 0, a null source is a source of its
    own and comes last, repeated rows are queued one by one, a null doc_id is shuffled as an empty text.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size"))
    sized = written(sized.withColumn("key", key), "sizes").withColumn("block", F.substring("key", 1, DIGITS))
    # at most one row a source; the blocks have at most 16 ** DIGITS rows a source
    sources = _sources(sized, weights, repeats)
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("offset", F.sum("words").over(W.partitionBy("source").orderBy("block")) - F.col("words"))
    blocks = blocks.join(sources, blocks["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    own = W.partitionBy("place", "block").orderBy("key", "size")
    a, b = sized.alias("a"), blocks.alias("b")
    queued = (a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block")))
              .select("doc_id", "size", "key", "a.block", "place", "source_size", "budget", "target", "offset")
              .withColumn("nth", F.row_number().over(own))
              .withColumn("start", F.col("offset") + F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")))
    queued = written(queued, "queue")
    goal = F.floor("target")
    copies = (queued.filter(F.col("size") > 0)
              .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
              .withColumn("start", F.col("start") + F.col("turn") * F.col("source_size"))
              .filter(F.col("start") < goal)
              .withColumn("end", F.least(F.col("start") + F.col("size"), goal))
              .withColumn("words", F.col("end") - F.col("start"))
              .withColumn("finish", F.col("end") / F.col("target"))
              .withColumn("slot", F.floor(F.col("finish") * SLOTS).cast("int")))
    # global prefix sums in the order of finish times: at most SLOTS + 1 slots, spread by parts of the key, then cut at the budget
    order = ["finish", "place", "key", "nth"]
    in_slot = W.partitionBy("slot").orderBy(*order)
    slots = copies.groupBy("slot").agg(F.sum("words").alias("slot_words"))
    slots = slots.withColumn("slot_offset", F.sum("slot_words").over(W.orderBy("slot")) - F.col("slot_words")).drop("slot_words")
    mixed = (copies.join(slots, "slot")
             .withColumn("before", F.col("slot_offset") + F.sum("words").over(in_slot.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
             .withColumn("words", F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("before")))))
    taken = mixed.groupBy("place", "block", "nth").agg(F.sum("words").alias("taken"), F.count_if(F.col("words") > 0).alias("copies"))
    return (queued.join(taken, ["place", "block", "nth"], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The documents of the mix: every row as often as copies of it are begun, with all its columns, whole.

    Rows that repeat a doc_id and a size share their copies in any order.
    """
    own = schedule(docs, weights, repeats).filter("copies > 0")
    nth = W.partitionBy("doc_id", "size").orderBy(F.lit(0))
    left = (docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _size(F.col("text")).alias("size"))
            .withColumn("nth", F.row_number().over(nth)).alias("a"))
    right = own.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "size").orderBy(F.desc("copies")))).select("doc_id", "size", "nth", "copies").alias("b")
    met = left.join(right, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.nth") == F.col("b.nth")))
    return met.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1] AS weight, source_size * {REPEATS} AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level,
  row_number() OVER (ORDER BY cap / weight, place) AS cap_place FROM w
  WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(level, cap_place) FROM l WHERE cap / weight >= level)) AS target FROM l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (SELECT sum(greatest(0, least(start + e * source_size + size, floor(target)) - start - e * source_size)) FROM range({REPEATS}) r(e))::BIGINT AS taken,
  CASE WHEN size = 0 THEN 0 ELSE (SELECT count(*) FROM range({REPEATS}) r(e) WHERE start + e * source_size < floor(target)) END::BIGINT AS copies
FROM q
"""
