"""Latest-wins plans. All give, for each key, the row of greatest ``seq``; they differ in physical strategy.

``window`` is the default: its group limit drops losers on both sides of the shuffle and it reads the log once.
``semi`` aggregates only (key, seq), so it hashes instead of sorting, at the price of a second scan. ``struct`` packs
the row into one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_window(log: DataFrame, keys=("key",), order="seq") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def by_semi(log: DataFrame, keys=("key",), order="seq") -> DataFrame:
    last = log.groupBy(*keys).agg(F.max(order).alias(order))
    return log.join(last, [*keys, order], "left_semi")


def by_struct(log: DataFrame, keys=("key",), order="seq") -> DataFrame:
    rest = [c for c in log.columns if c not in keys and c != order]
    return log.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), order).alias("_row")).select(*keys, "_row.*").select(log.columns)


STRATEGIES = {"window": by_window, "semi": by_semi, "struct": by_struct}
