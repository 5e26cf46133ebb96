"""Project roll-ups and job planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import blank


def project_rollup(projects: DataFrame, pages: DataFrame, shares: DataFrame, jobs: DataFrame, user: Column) -> DataFrame:
    """Each project with its pages, pages with text, first page, latest job, and for the owner whom it is shared with.

    jobs: project_id, status, current, total.
    """
    counts = pages.groupBy("project_id").agg(
        F.count("*").alias("image_count"),
        F.count_if(F.col("text").isNotNull() & (F.col("text") != "")).alias("transcribed_count"),
        F.min_by("name", "page_id").alias("first_image"),
    )
    shared = shares.groupBy("project_id").agg(F.array_sort(F.collect_set("user_id")).alias("_shared"))
    j = projects.join(counts, "project_id", "left").join(shared, "project_id", "left").join(jobs.select("project_id", "status", "current", "total"), "project_id", "left")
    own = F.col("owner_id") == user
    return j.select(
        *projects.columns,
        F.coalesce("image_count", F.lit(0)).cast("long").alias("image_count"),
        F.coalesce("transcribed_count", F.lit(0)).cast("long").alias("transcribed_count"),
        "first_image",
        F.col("status").alias("job_status"),
        "current",
        "total",
        F.coalesce(own, F.lit(False)).alias("is_owner"),
        F.when(own, F.coalesce("_shared", F.array().cast("array<bigint>"))).alias("shared_with"),
    )


def eligible_projects(rollup: DataFrame, kind: str = "transcribe") -> DataFrame:
    """transcribe: with pages; download: of type iiif, with a url and no job that runs, waits or is done."""
    if kind == "transcribe":
        return rollup.where("image_count > 0")
    busy = F.coalesce(F.col("job_status").isin("running", "pending", "waiting", "completed"), F.lit(False))
    return rollup.where((F.col("type") == "iiif") & ~blank(F.col("iiif_url")) & ~busy)


def resume_pages(pages: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, start, page_no) of the pages still to load; one row without page_no for a conflict.

    projects: project_id, job_status, current, existing, choice (append, restart or null). A cancelled job goes on after its
    last page; otherwise append starts after the existing pages, restart at 1, and existing pages without a choice are a
    conflict (start is null).
    """
    start = (
        F.when(F.col("job_status") == "cancelled", F.col("current") + 1)
        .when(F.col("choice") == "append", F.col("existing") + 1)
        .when((F.col("choice") == "restart") | (F.coalesce("existing", F.lit(0)) == 0), F.lit(1))
    )
    p = projects.select("project_id", start.cast("long").alias("start"))
    rest = p.join(pages.select("project_id", "page_no"), "project_id").where(F.col("page_no") >= F.col("start"))
    conflict = p.where("start is null").withColumn("page_no", F.lit(None).cast(rest.schema["page_no"].dataType))
    return rest.unionByName(conflict)


def progress_rollup(events: DataFrame) -> DataFrame:
    """Latest status and progress of each project from (project_id, ts, status, progress); streams in update mode."""
    return events.groupBy("project_id").agg(F.max_by(F.struct("status", "progress", "ts"), "ts").alias("x")).select("project_id", "x.*")
