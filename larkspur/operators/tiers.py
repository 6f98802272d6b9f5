"""Tiered charges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tiered_charge(used: Column, tiers: Column) -> Column:
    """Cents for `used` units; tiers: array of structs (tier, upper, rate) in any order, upper null or 0 for no end.

    A tier charges the units between the upper bound of the one before and its own. No use costs nothing.
    """
    start = F.struct(F.lit(0).cast("long").alias("floor"), F.lit(0).cast("long").alias("cents"))

    def step(acc: Column, tier: Column) -> Column:
        top = F.when(F.coalesce(tier["upper"], F.lit(0)) == 0, F.greatest(used, acc["floor"])).otherwise(tier["upper"]).cast("long")
        within = F.greatest(F.least(used, top) - acc["floor"], F.lit(0))
        return F.struct(top.alias("floor"), (acc["cents"] + within * tier["rate"]).cast("long").alias("cents"))

    return F.aggregate(F.array_sort(tiers), start, step)["cents"]
