"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Sizes give every source a target by capped weights; each source's demand over the run is the integral of its weight
schedule, and inverting the cumulative demand gives each taken document its place in training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: A source may be repeated at most this many times.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Rows of a source are dealt by hash into this many bins, so that a source of a third of all rows has as many tasks.
BINS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """``source``, ``source_size`` -> and ``weight``, ``target``: words that each source should give.

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ...; they share ``share`` of all words by weight, no
    target exceeds ``MOST`` times its source's size and the excess goes to the others by weight. In the order of size to
    weight the capped sources come first, so one running sum finds the level at which nothing is above its cap. One row for
    each source, so the windows over the whole table are small whatever the number of documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*map(F.lit, WEIGHTS))
    rows = sizes.withColumn("weight", F.get(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS)).cast("int")).cast("long"))
    total = F.sum("source_size").over(Window.partitionBy())
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("goal", total * F.lit(share))
    rows = rows.withColumn("level", (F.col("goal") - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    # the first row whose share at its own level is below its cap: from there on all are shared out at that level
    fits = F.col("level") * F.col("weight") <= MOST * F.col("source_size")
    rows = rows.withColumn("at", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").alias("s"), F.col("level").alias("level")))).over(Window.partitionBy()))
    capped = F.coalesce(F.col("at.level") * F.col("weight") > MOST * F.col("source_size"), F.lit(True))
    target = F.when(capped, (MOST * F.col("source_size")).cast("double")).otherwise(F.col("at.level") * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _schedule(weight: Column) -> Column:
    """Slope of a source's weight over the run, -1 to 1: light sources fade out, heavy ones come in."""
    return (weight - 2).cast("double") * 0.5


def position(share: Column, slope: Column) -> Column:
    """The time in 0..1 by which ``share`` of a source's demand is used.

    The weight at time t is proportional to 1 - slope / 2 + slope * t (its integral over the run is 1), so the cumulative
    demand is (1 - slope / 2) t + slope t^2 / 2; this is its inverse, in the form that is stable at slope 0.
    """
    a = F.lit(1.0) - slope / 2
    return 2 * share / (a + F.sqrt(a * a + 2 * slope * share))


def _same(left: str, right: str, *more: str) -> Column:
    """Equal sources, null equal to null, and equal ``more``."""
    met = F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))
    for c in more:
        met = met & (F.col(f"{left}.{c}") == F.col(f"{right}.{c}"))
    return met


def _fitting(rows: DataFrame, room: DataFrame) -> DataFrame:
    """``rows`` with ``upto``, the sum of sizes of the source up to and with the row in the order of keys, and ``room``, ``fits``.

    ``room``: ``source``, ``bin``, ``room``. Rows are summed within bins, the bins' sums in a table of one row for each source and bin,
    so a hot source is spread over its bins.
    """
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("before", before).alias("s").join(room.alias("p"), _same("s", "p", "bin")).select("s.source", "s.bin", "before", "room")
    inner = Window.partitionBy("source", "bin").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("upto", F.sum("size").over(inner))
    met = within.alias("r").join(offsets.alias("o"), _same("r", "o", "bin")).select("r.*", "o.before", "o.room")
    met = met.withColumn("upto", F.col("upto") + F.col("before")).drop("before")
    return met.withColumn("fits", F.col("upto") <= F.col("room"))


def _left_over(rows: DataFrame) -> DataFrame:
    """``source``, ``bin``, ``room``: what the rows that fit leave of each source's room."""
    bins = rows.groupBy("source", "bin").agg(F.max("room").alias("room"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("got"))
    whole = Window.partitionBy("source")
    return bins.select("source", "bin", (F.max("room").over(whole) - F.sum("got").over(whole)).alias("room"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``, ``weight``, ``upto``, ``key``.

    ``size`` counts words (null or empty text: 0); ``taken`` = ``copies`` * ``size``. A source repeats all its documents
    as often as its target allows in whole, then the first documents of a fixed random order (a digest of id and size)
    while they fit; of the others, those no larger than what is missing are gone through once more in the same way, and last
    the one remaining document that comes nearest what is still missing is taken, if that brings the sum nearer.
    ``upto`` is the sum of sizes of the source up to and with the document, in that order. Order and ties are settled by id and
    size, so reruns agree; equal rows are alike. Nulls in the source form a source of their own, last; a null id is one id.
    A source without words has target 0 and takes nothing. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    size = word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("row"))
    key = F.md5(F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    rows = rows.withColumn("key", key)
    rows = scratch.keep(rows.withColumn("bin", F.conv(F.substring("key", 1, 2), 16, 10).cast("int")), "sizes")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    targets = source_targets(bins.groupBy("source").agg(F.sum("n").alias("source_size")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("rounds", full).withColumn("room", F.col("target") - F.col("rounds") * F.col("source_size"))
    plan = scratch.keep(bins.alias("b").join(plan.alias("p"), _same("b", "p")).select("b.source", "b.bin", "p.source_size", "p.weight", "p.target", "p.rounds", "p.room"), "plan")
    placed = scratch.keep(_fitting(rows, plan.select("source", "bin", "room")), "placed")
    left = _left_over(placed)
    others = placed.where("not fits and size > 0").drop("upto", "room", "fits")
    smaller = others.alias("r").join(left.alias("o"), _same("r", "o", "bin")).where("r.size <= o.room").select("r.*")
    second = scratch.keep(_fitting(smaller, left), "second")
    # what both passes leave, and the document outside that fills it best
    got = second.where("fits").groupBy("source").agg(F.sum("size").alias("got"))
    gap = left.groupBy("source").agg(F.max("room").alias("room")).alias("l").join(got.alias("g"), _same("l", "g"), "left").select("l.source", (F.col("room") - F.coalesce("got", F.lit(0))).alias("gap"))
    chosen = second.where("fits").select("row")
    outside = others.join(chosen, "row", "left_anti").groupBy("source", "size").agg(F.min(F.struct("key", "id", "row")).alias("first"))
    filler = outside.alias("o").join(gap.alias("g"), _same("o", "g")).where(F.abs(F.col("gap") - F.col("size")) < F.col("gap"))
    filler = filler.groupBy("o.source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "size", "first")).alias("f")).select(F.col("f.first.row").alias("row"))
    rows = placed.alias("r").join(plan.alias("p"), _same("r", "p", "bin")).select("r.*", "p.source_size", "p.weight", "p.target", "p.rounds")
    rows = rows.join(chosen.union(filler).withColumn("more", F.lit(True)), "row", "left")
    copies = F.col("rounds") + F.when(F.col("fits") | F.col("more"), 1).otherwise(0)
    copies = F.when(F.col("source_size") > 0, copies).otherwise(0).cast("long")
    rows = rows.withColumn("copies", F.least(copies, F.lit(MOST)))
    return rows.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "weight", "upto", "key")


def curriculum(mixed: DataFrame) -> DataFrame:
    """Each taken copy with its training ``position`` (0 to 1); a copy's round comes first, its place in the source then."""
    copies = mixed.where("copies > 0").withColumn("round", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    share = F.least(F.lit(1.0), (F.col("round") * F.col("source_size") + F.col("upto") - F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0)))
    return copies.withColumn("position", position(share, _schedule(F.col("weight"))))


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs``, range-sorted by its first copy's training position, those not placed last.

    ``id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (copies that the curriculum placed, times
    ``size``) and ``position``, ``position_2``, ``position_3`` (of the copies, ascending; null where there is none).
    """
    scratch = scratch or Scratch(docs.sparkSession, "placements")
    mixed = scratch.keep(mix(docs, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id()), "mixed")
    placed = curriculum(mixed).groupBy("row").agg(F.sum("size").alias("taken"), F.sort_array(F.collect_list("position")).alias("at"))  # MOST entries
    rows = mixed.drop("taken").join(placed, "row", "left")
    places = [F.get("at", F.lit(k)).alias(f"position_{k + 1}" if k else "position") for k in range(MOST)]
    rows = rows.select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), *places, "row")
    order = [F.col("position").asc_nulls_last(), F.col("row")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
