"""Building blocks over ordered rows of a group: islands, greedy pairing, fill forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(keys: list[str], order: list[str]):
    """From the group's first row to the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def island(starts: Column, keys: list[str], order: list[str]) -> Column:
    """Number of the island a row belongs to; `starts` marks its first row."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(running(keys, order))


def greedy_pairs(df: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """df with `_leads`: rows that take the next row, chosen from left to right among those flagged.

    In a run of consecutive flags the first, third, fifth and so on lead; a group's last row never does.
    """
    w = ordered(keys, order)
    df = df.withColumn("_flag", F.coalesce(flag & F.lead(F.lit(True)).over(w), F.lit(False)))
    df = df.withColumn("_run", island(~F.col("_flag"), keys, order))
    place = F.sum(F.col("_flag").cast("int")).over(running([*keys, "_run"], order))
    return df.withColumn("_leads", F.col("_flag") & (place % 2 == 1)).drop("_flag", "_run")


def fill_forward(value: Column, keys: list[str], order: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(running(keys, order))
