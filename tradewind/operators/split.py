"""Exact stratified split: the share of each class, no more and no less.

Every unit (an order with all its rows, a customer) has a hash of its key; of
each class the units with the smallest hashes are the training part, exactly
round(share * n) of them. The hash at which a class is cut is selected without
sorting it: units are counted by class and the hash's first four hex digits, a
running sum over these counts finds the group in which the cut lies, and only
that group's units are ranked. Two numbers a class reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the groups: 65536 groups a class.
GROUP_DIGITS = 4


def unit_hash(key: Column, seed: int) -> Column:
    """32 hex digits; any database's MD5 gives the same."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def cuts(units: DataFrame, share: float) -> dict:
    """The hash of the last training unit of each class ('' where none is). ``units``: cls, h."""
    counts = units.groupBy("cls", F.substring("h", 1, GROUP_DIGITS).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("cls").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("cls")
    counts = counts.select("cls", "g", "n", F.sum("n").over(up_to).alias("upto"), F.sum("n").over(whole).alias("all"))
    wanted = F.floor(F.col("all") * F.lit(share) + 0.5)
    at = counts.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).select(
        "cls", "g", (wanted - (F.col("upto") - F.col("n"))).alias("left"))
    mine = units.select("cls", "h", F.substring("h", 1, GROUP_DIGITS).alias("mine"))
    at = at.select(F.col("cls").alias("of"), "g", "left")
    inside = mine.join(at, F.col("cls").eqNullSafe(F.col("of")) & (F.col("mine") == F.col("g"))).select("cls", "h", "left")
    nth = Window.partitionBy("cls").orderBy("h")
    last = inside.withColumn("nth", F.row_number().over(nth)).where("nth = left").select("cls", "h")
    classes = {r["cls"]: "" for r in counts.select("cls").distinct().collect()}
    return classes | {r["cls"]: r["h"] for r in last.collect()}


def with_class(rows: DataFrame, key: str, label: str, cls: str = "_class") -> DataFrame:
    """``rows`` and their key's class, the largest label of its rows: no exchange where the
    rows lie by the key already."""
    return rows.withColumn(cls, F.max(label).over(Window.partitionBy(key)))


def stratified(rows: DataFrame, key: str, label: str, share: float, seed: int, cls: str | None = None) -> DataFrame:
    """``rows`` with ``part``: 'train' or 'test', the same for all rows of a key. A key's
    class is the largest label of its rows; ``cls`` names the column that holds it, if one does."""
    if not 0 <= share <= 1:
        raise ValueError(f"a share of {share}")
    units = rows.groupBy(key).agg(F.max(cls or label).alias("cls")).withColumn("h", unit_hash(F.col(key), seed))
    cut = cuts(units.select("cls", "h"), share)
    rows = (rows if cls else with_class(rows, key, label)).drop("part").withColumn("_hash", unit_hash(F.col(key), seed))
    of, train = F.col(cls or "_class"), F.lit(False)
    for c, h in cut.items():
        mine = of.isNull() if c is None or (isinstance(c, float) and math.isnan(c)) else of == F.lit(c)
        train = train | (mine & (F.col("_hash") <= F.lit(h)))
    return rows.withColumn("part", F.when(F.coalesce(train, F.lit(False)), "train").otherwise("test")).drop(cls or "_class", "_hash")
