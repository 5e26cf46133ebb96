"""Streams: repairing new pages as they come, and the latest progress of each project."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.functions.text import Rule, apply_fix_rules, parse_markup
from folioflow.operators.projects import progress_rollup


def fix_pages(pages: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Pages with repaired text and its parts; stateless, so it works on batches and streams alike."""
    fixed = pages.withColumn("text", apply_fix_rules(F.col("text"), rules))
    return fixed.withColumn("parts", parse_markup(F.col("text")))


def stream_fix(pages: DataFrame, load_rules: Callable[[], Iterable[Rule]], path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Repair a stream of pages into Parquet; the rules are loaded anew for every micro-batch.

    A batch is written to a folder of its own number, overwriting, so that a batch that runs again leaves no doubles.
    """

    def write(batch: DataFrame, number: int) -> None:
        fix_pages(batch, load_rules()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_progress(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Latest status of each project of a stream of job events, in update mode.

    sink(batch, number) gets, for each micro-batch, only the projects whose latest status is new in it, for example to merge
    them into a table; a number comes again if a batch is run again. State is one row for each project.
    """
    writer = progress_rollup(events).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
