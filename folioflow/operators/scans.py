"""Running values over ordered rows where one group may hold any share of them.

A window over a group sorts all of it in one task. A scan cuts the rows, ordered by group and order, into ranges; each range is
worked on alone, what it hands on (a sum, its last value) is carried over the ranges of a group, at most one row for
each range and group, and joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.lineage import checkpointed


class Scan:
    """Rows of df by keys and order (columns, or sort expressions), which tell all rows of a group apart.

    `df` has the rows with the columns added so far; `_part`, the range, is one of them. The names `_part` and
    `_carry` are taken.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str | Column], parts: int | None = None):
        spark = df.sparkSession
        self.keys, self.order = keys, order
        ranges = df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, *order)
        # ranges are chosen by a sample of the rows, so they are written before anything depends on them
        self.df = checkpointed(ranges.withColumn("_part", F.spark_partition_id()), spark)
        self.here = Window.partitionBy(*keys, "_part").orderBy(*order)
        self.running = self.here.rowsBetween(Window.unboundedPreceding, 0)
        self.before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def _carried(self, handed_on: Column, carry: Column) -> DataFrame:
        """df with `_carry`: carry, over `_x` of a group's earlier ranges; `_x` is what each of them hands on."""
        ends = self.df.groupBy(*self.keys, "_part").agg(handed_on.alias("_x"))
        ends = ends.select(*(F.col(k).alias(f"_of_{i}") for i, k in enumerate(self.keys)), F.col("_part").alias("_of"), carry.alias("_carry"))
        alike = [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(self.keys)] + [F.col("_part") == F.col("_of")]
        return self.df.join(ends, reduce(Column.__and__, alike)).drop("_of", *(f"_of_{i}" for i in range(len(self.keys))))

    def total(self, value: Column, name: str) -> Scan:
        """Add the sum of value over the rows up to this one."""
        df = self._carried(F.sum(value), F.coalesce(F.sum("_x").over(self.before), F.lit(0)))
        self.df = df.withColumn(name, F.coalesce(F.sum(value).over(self.running), F.lit(0)) + F.col("_carry")).drop("_carry")
        return self

    def number(self, name: str) -> Scan:
        """Add the number of the row in its group, from 1."""
        return self.total(F.lit(1).cast("long"), name)

    def previous(self, value: Column, name: str) -> Scan:
        """Add the value of the row before, null for a group's first."""
        self.df = self.df.withColumn("_place", F.row_number().over(self.here))
        last = F.max_by(F.struct(value.alias("v")), "_place")
        df = self._carried(last, F.last("_x").over(self.before))
        self.df = df.withColumn(name, F.when(F.col("_place") == 1, F.col("_carry.v")).otherwise(F.lag(value).over(self.here))).drop("_carry", "_place")
        return self

    def latest(self, value: Column, name: str) -> Scan:
        """Add the last value up to this row that is not null."""
        self.df = self.df.withColumn("_place", F.row_number().over(self.here))
        last = F.max_by(value, F.when(value.isNotNull(), F.col("_place")))
        df = self._carried(last, F.last("_x", ignorenulls=True).over(self.before))
        self.df = df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(self.running), F.col("_carry"))).drop("_carry", "_place")
        return self

    def leads(self, flag: Column, name: str) -> Scan:
        """Add whether the row takes the next one, chosen from left to right among those flagged: the first, third, fifth of a run.

        The flag of a group's last row must be false.
        """
        on = F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("long")
        self.total(on, "_flags").latest(F.when(~F.coalesce(flag, F.lit(False)), F.col("_flags")), "_gone")
        place = F.col("_flags") - F.coalesce("_gone", F.lit(0))
        self.df = self.df.withColumn(name, F.coalesce(flag, F.lit(False)) & (place % 2 == 1)).drop("_flags", "_gone")
        return self

    def rows(self) -> DataFrame:
        return self.df.drop("_part")
