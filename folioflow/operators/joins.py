"""Dictionary, mapping and set joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import blank, nonblank


def _by_key(dictionary: DataFrame, key: str, prefix: str, columns: list[str]) -> DataFrame:
    """One row for each key (the least row), columns prefixed."""
    d = dictionary.where(F.col(key).isNotNull()).select(F.col(key).alias(f"{prefix}key"), F.struct(*columns).alias("_s"))
    return d.groupBy(f"{prefix}key").agg(F.min("_s").alias("_s")).select(f"{prefix}key", *(F.col(f"_s.{c}").alias(f"{prefix}{c}") for c in columns))


def dict_lookup(df: DataFrame, dictionary: DataFrame, col: str) -> DataFrame:
    """`col`_display and `col`_export from dictionary (value, label, export_value): by value, else by trimmed lower label.

    Raw values that are not found are passed on. Sides are joined as Spark sees fit: a small dictionary is broadcast.
    """
    by_value = _by_key(dictionary, "value", "_v_", ["label", "export_value"])
    labelled = dictionary.withColumn("_label", F.lower(F.trim("label")))
    by_label = _by_key(labelled, "_label", "_l_", ["label", "export_value"])
    raw = F.col(col).cast("string")
    j = df.join(by_value, raw == F.col("_v_key"), "left").join(by_label, F.lower(F.trim(raw)) == F.col("_l_key"), "left")
    pick = lambda c: F.when(F.col("_v_key").isNotNull(), F.col(f"_v_{c}")).when(F.col("_l_key").isNotNull(), F.col(f"_l_{c}"))
    return j.select(*df.columns, F.coalesce(pick("label"), raw).alias(f"{col}_display"), F.coalesce(pick("export_value"), raw).alias(f"{col}_export"))


def automatic_column(df: DataFrame, dictionary: DataFrame, parent: str, out: str) -> DataFrame:
    """out: the label of the parent column's value, else N/A."""
    by_value = _by_key(dictionary, "value", "_v_", ["label"])
    j = df.join(by_value, F.col(parent).cast("string") == F.col("_v_key"), "left")
    return j.select(*df.columns, F.coalesce("_v_label", F.lit("N/A")).alias(out))


def list_items(col: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def list_lookup(df: DataFrame, dictionary: DataFrame, col: str, key: str, out: str) -> DataFrame:
    """out: the items of a , or ; separated list, each as its label if the dictionary has it, joined by ', '."""
    by_value = _by_key(dictionary, "value", "_v_", ["label"])
    items = df.select(key, F.posexplode(list_items(F.col(col))).alias("_i", "_item")).join(by_value, F.col("_item") == F.col("_v_key"), "left")
    labels = F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_v_label", "_item").alias("t"))))
    joined = items.groupBy(key).agg(F.array_join(F.transform(labels, lambda x: x["t"]), ", ").alias(out))
    return df.join(joined, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def mapping_join(df: DataFrame, mapping: DataFrame, src: str, dst: str) -> DataFrame:
    """dst where it is blank: the mapping's target of src, if there is a non-blank one."""
    m = mapping.where(~blank(F.col("target"))).groupBy(F.col("source").alias("_source")).agg(F.min("target").alias("_target"))
    j = df.join(m, F.col(src).cast("string") == F.col("_source"), "left")
    filled = F.coalesce(nonblank(F.col(dst).cast("string")), F.col("_target"), F.col(dst).cast("string"))
    return j.withColumn(dst, filled).select(*df.columns)


def accessible_projects(projects: DataFrame, shares: DataFrame, user: Column) -> DataFrame:
    """Projects that the user owns or that are shared with them, each once."""
    shared = projects.join(shares.where(F.col("user_id") == user).select("project_id"), "project_id", "left_semi")
    return projects.where(F.col("owner_id") == user).unionByName(shared).distinct()


def shared_users(users: DataFrame, shares: DataFrame) -> DataFrame:
    return users.join(shares.select("project_id", "user_id"), "user_id").select("project_id", *users.columns)


def union_ids(owned: DataFrame, shared: DataFrame, key: str = "project_id") -> DataFrame:
    return owned.select(key).union(shared.select(key)).distinct()


def share_diff(current: DataFrame, wanted: DataFrame, users: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, user_id, action): add wanted users that exist and are not the owner, remove those not wanted."""
    pairs = ["project_id", "user_id"]
    owner = projects.select("project_id", F.col("owner_id").alias("user_id"))
    add = wanted.select(pairs).distinct().join(users.select("user_id"), "user_id", "left_semi").join(owner, pairs, "left_anti").join(current, pairs, "left_anti")
    remove = current.select(pairs).distinct().join(wanted, pairs, "left_anti")
    return add.select(*pairs, F.lit("add").alias("action")).unionByName(remove.select(*pairs, F.lit("remove").alias("action")))


def content_diff(current: DataFrame, edited: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action) of rows to create, update or delete so that current becomes edited; unchanged rows are left out."""
    a = current.select(key, F.struct(*columns).alias("_a"))
    b = edited.select(key, F.struct(*columns).alias("_b"))
    action = F.when(F.col("_a").isNull(), "create").when(F.col("_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return a.join(b, key, "full").select(key, action.alias("action")).where("action is not null")


def apply_changes(df: DataFrame, create: DataFrame, update: DataFrame, delete: DataFrame, key: str = "row_id", scope: str = "project_id") -> DataFrame:
    """df with rows deleted, replaced and added. A change of a row of another project is an error that stops the job."""
    owner = df.select(F.col(key), F.col(scope).alias("_of"))

    def checked(changes: DataFrame) -> DataFrame:
        j = changes.join(owner, key, "left")
        fine = F.when(F.col("_of").isNull() | (F.col("_of") == F.col(scope)), F.col(scope))
        return j.withColumn(scope, F.coalesce(fine, F.raise_error(F.concat(F.lit("row of another project: "), F.col(key).cast("string"))).cast(df.schema[scope].dataType)))

    update, delete = checked(update).select(df.columns), checked(delete).select(key, scope)
    gone = update.select(key, scope).union(delete).distinct()
    kept = df.join(gone, [key, scope], "left_anti")
    return kept.unionByName(update.join(owner, key, "left_semi").select(df.columns)).unionByName(create.select(df.columns))


def reference_violations(df: DataFrame, dictionary: DataFrame, key: str, col: str, kind: str = "select") -> DataFrame:
    """(key, column, value) of values not in the dictionary: select by value or label, list by item, number by value."""
    values = dictionary.select(F.col("value").cast("string").alias("_v")).where("_v is not null").distinct()
    raw = F.col(col).cast("string")
    if kind == "list":
        items = df.select(key, F.explode(list_items(raw)).alias("value"))
    else:
        items = df.where(~blank(raw)).select(key, raw.alias("value"))
    out = items.join(values, F.col("value") == F.col("_v"), "left_anti")
    if kind == "select":
        labels = dictionary.select(F.lower(F.trim("label")).alias("_l")).distinct()
        out = out.join(labels, F.lower(F.trim("value")) == F.col("_l"), "left_anti")
    return out.select(key, F.lit(col).alias("column"), "value")


def segment_pages(segments: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """First and last page of each segment [seg_start, seg_end) by character offsets; pages carry [page_start, page_end).

    Both sides fall into buckets of offsets, so the join is an equi-join with a small rest.
    """
    size = 4096
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / size)))
    s = segments.withColumn("_bucket", spread("seg_start", "seg_end"))
    p = pages.select(*keys, "page_id", "page_start", "page_end").withColumn("_bucket", spread("page_start", "page_end"))
    hit = s.join(p, [*keys, "_bucket"]).where((F.col("page_start") < F.col("seg_end")) & (F.col("page_end") > F.col("seg_start")))
    return hit.groupBy(*keys, "seg_start", "seg_end").agg(F.min_by("page_id", "page_start").alias("from_page"), F.max_by("page_id", "page_start").alias("to_page"))


def order_by_label(df: DataFrame, label: str = "label", locale: str = "UNICODE") -> DataFrame:
    return df.orderBy(F.collate(F.col(label), locale))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")
