"""Exact elements of sorted columns, found without sorting a group in one task."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_statistics(df: DataFrame, group: list[str], value: str, places: dict[str, float], falling: bool = False) -> DataFrame:
    """(group columns, n, one column for each of ``places``): the element at floor(n * share) of a group's sorted values, the last one at most.

    Nulls are left out; a group of nulls only has no row. Rows are ranged by group and value (one shuffle of these columns, each task sorts its own
    range), ranges are counted, and the element is taken from the range that holds its number; so a group may be as large as the table.
    """
    keys = [F.col(g) for g in group]
    order = [*keys, F.col("_v").desc() if falling else F.col("_v").asc()]
    rows = df.select(*group, F.col(value).alias("_v")).where("_v is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    mask = F.lit((1 << 33) - 1)
    tagged = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(mask)).drop("_id").persist(StorageLevel.DISK_ONLY)
    # one row for each range and the groups in it
    ranges = tagged.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = W.partitionBy(*group)
    ranges = ranges.withColumn("_before", F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).withColumn("n", F.sum("_n").over(whole))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * share), F.col("n") - 1).alias("at")) for name, share in places.items()))).alias("_w")
    marks = ranges.select(*group, "_part", "_first", "_before", "_n", "n", wanted).where("_w.at >= _before and _w.at < _before + _n")
    marks = marks.select(*(F.col(g).alias(f"_{k}") for k, g in enumerate(group)), "_part", (F.col("_first") + F.col("_w.at") - F.col("_before")).alias("_row"), "n", F.col("_w.name").alias("_name"))
    found = marks.join(tagged.select("_part", "_row", "_v"), ["_part", "_row"])
    return found.groupBy(*(F.col(f"_{k}").alias(g) for k, g in enumerate(group)), "n").agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places))


def with_all(df: DataFrame, column: str, name: str = "all") -> DataFrame:
    """Every row twice: once in its group and once in the group ``name``."""
    return df.withColumn(column, F.explode(F.array(F.col(column), F.lit(name))))


def better(score: Column, places: int, *then: str) -> Column:
    """A value that is smaller for what ranks before: higher scores, rounded, then the columns named."""
    return F.struct((-F.round(score, places)).alias("s"), *then)
