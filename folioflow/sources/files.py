"""Readers and writers of dictionaries, rules, manifests, tables and page files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import blank, nonblank, normalize_header, parse_bool, parse_number, trim_all
from folioflow.operators.joins import automatic_column, dict_lookup, list_lookup
from folioflow.operators.table import unique_labels
from folioflow.plans.structures import ColumnSpec, conform, quoted


def _header(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    return first[0]["value"].lstrip("﻿") if first else ""


def _read(spark: SparkSession, path: str, sep: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=header, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, enforceSchema=False)


def separator(header: str, among: str = "\t,") -> str:
    """The first of `among` that the header has more of than of the second."""
    return among[0] if header.count(among[0]) > header.count(among[1]) else among[1]


def read_dictionary(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """A header CSV or TSV as text columns, cells in lower case unless told otherwise."""
    df = _read(spark, path, separator(_header(spark, path)))
    return df.select(*(F.lower(quoted(c)).alias(c) if lower else F.col(quoted(c)) for c in df.columns))


def read_dictionary_columns(spark: SparkSession, path: str, kind: str = "select", key: str | None = None, display: str | None = None, export: str | None = None) -> DataFrame:
    """(value, label, export_value) of rows whose key and label are non-blank, by label."""
    listed = kind in ("select", "list")
    key, display = key or ("name" if listed else "id"), display or ("name" if listed else "text")
    export = export or (display if kind == "automatic" else key)
    df = read_dictionary(spark, path, lower=False)
    out = df.where(~blank(F.col(quoted(key))) & ~blank(F.col(quoted(display))))
    return out.select(F.col(quoted(key)).alias("value"), F.col(quoted(display)).alias("label"), F.col(quoted(export)).alias("export_value")).orderBy(F.collate("label", "UNICODE"))


def _placed(df: DataFrame) -> DataFrame:
    """df, just read, with `_file` and `_block` (path, and place in the file of the split read) and `_at`, which grows within them."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def _last(df: DataFrame, key: str, value: str) -> DataFrame:
    """The last row of each key, by file name and place; df was just read."""
    return _placed(df).groupBy(key).agg(F.max_by(value, F.struct("_file", "_block", "_at")).alias(value))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(id, text); a later row of an id wins."""
    return _last(_read(spark, path, ",").select("id", "text"), "id", "text")


def read_fix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(mistake, replacement, full_word) of rows with both sides non-blank."""
    df = _read(spark, path, "\t")
    by = {normalize_header(c): c for c in df.columns}
    col = lambda name: F.col(quoted(by[name]))
    rows = df.select(col("mistake").alias("mistake"), col("shouldbereplacedwith").alias("replacement"), (F.upper(F.trim(col("isfullword"))) == "TRUE").alias("full_word"))
    return rows.where(~blank(F.col("mistake")) & ~blank(F.col("replacement"))).withColumn("full_word", F.coalesce("full_word", F.lit(False)))


def rule_list(rules: DataFrame) -> list[tuple[str, str, bool]]:
    """A rule file's rows for building one pattern; a rule file is a small, hand-written list."""
    return [(r["mistake"], r["replacement"], r["full_word"]) for r in rules.toLocalIterator()]


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(source, target); the last row of a source wins."""
    df = _read(spark, path, separator(_header(spark, path)))
    return _last(df.select("source", "target"), "source", "target")


def read_project_manifest(spark: SparkSession, path: str, skip_without_iiif: bool = False) -> DataFrame:
    """(name, iiif_url, type) of rows with a name; type is iiif with a url, else files."""
    df = _read(spark, path, separator(_header(spark, path), ";,"))
    find = lambda *words: next((c for c in df.columns if any(w in c.lower() for w in words)), None)
    name, url = find("name", "projekt", "project"), find("iiif", "url", "manifest")
    if name is None:
        raise ValueError("no column of names")
    link = F.coalesce(F.trim(quoted(url)), F.lit("")) if url else F.lit("")
    out = df.select(F.trim(quoted(name)).alias("name"), link.alias("iiif_url")).where(~blank(F.col("name")))
    out = out.withColumn("type", F.when(F.col("iiif_url") != "", "iiif").otherwise("files"))
    return out.where("iiif_url <> ''") if skip_without_iiif else out


def coerce(value: Column, spec: ColumnSpec) -> Column:
    if spec.type in ("number", "sequence"):
        return parse_number(value)
    return parse_bool(value) if spec.type == "boolean" else value


def import_table(spark: SparkSession, path: str, structure: list[ColumnSpec]) -> DataFrame:
    """A header CSV as a table of the structure; headers match by name, else by display name without case, space, _ and -.

    Derived columns are left out of the file's match and stay empty. If the numbers of the sequence column are not
    complete, integer and unique, rows are numbered by file name and their place in the file.
    """
    raw = _read(spark, path, separator(_header(spark, path)))
    shown = {normalize_header(c): c for c in raw.columns}
    raw, place = _placed(raw), ("_file", "_block", "_at")
    cols: list[Column] = [F.col(c) for c in place]
    for s in structure:
        source = s.name if s.name in raw.columns else shown.get(normalize_header(s.display))
        if source is not None and not s.derived:
            cols.append(coerce(F.col(quoted(source)), s).alias(s.name))
    out = conform(raw.select(*cols), structure, keep=place)
    seq = next((s.name for s in structure if s.type == "sequence"), None)
    if seq:
        q = out.agg((F.count("*") == F.count(quoted(seq))).alias("a"), (F.count(quoted(seq)) == F.count_distinct(quoted(seq))).alias("b")).first()
        if not (q["a"] and q["b"]):
            out = numbered(out, "_at", seq, ("_file", "_block"))
    return out.drop(*place)


def numbered(df: DataFrame, at: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with out: its rows numbered from 1 in the order of `by`, then of `at`, made before by monotonically_increasing_id.

    Rows alike in `by` stand together in a partition. Partitions hold files by size, not by name, so rows of several files
    need their names in `by`. Only one count for each file, or split of one, and partition passes through the driver, so no task sees more than its own rows.
    """
    part, keys = F.shiftright(at, 33), [*by, "_p"]
    sizes = df.withColumn("_p", part).groupBy(*keys).agg(F.min(at).alias("_first"), (F.max(at) - F.min(at) + 1).alias("_n")).orderBy(*keys).collect()
    before, rows = 0, []
    for r in sizes:
        rows.append((*(r[k] for k in keys), r["_first"], before))
        before += r["_n"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema} | {"_p": "long"}
    offsets = df.sparkSession.createDataFrame(rows, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_first long", "_before long"]))
    j = df.withColumn("_p", part).join(offsets, keys).withColumn(out, (F.col("_before") + F.col(at) - F.col("_first") + 1).cast("long"))
    return j.select(df.columns if out in df.columns else [*df.columns, out])


def read_content(df: DataFrame, structure: list[ColumnSpec], keys: tuple[str, ...] = ("project_id", "content_id")) -> DataFrame:
    """JSON objects in `data` as columns of the structure; other rows are left out, missing keys get defaults.

    Rows without a number are numbered by their place in the project.
    """
    parsed = df.withColumn("_m", F.from_json(F.when(F.trim("data").startswith("{"), F.col("data")), "map<string,string>", {"mode": "PERMISSIVE"})).where("_m is not null")
    cells = [coerce(F.col("_m")[s.name], s).alias(s.name) for s in structure if not s.derived]
    out = conform(parsed.select(*keys, *cells), structure, keep=keys)
    seq = next((s.name for s in structure if s.type == "sequence"), None)
    if seq:
        place = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:])).cast("long")
        out = out.withColumn(seq, F.coalesce(F.col(quoted(seq)), place))
    return out


_V2 = "label variant, sequences array<struct<canvases: array<struct<label: variant, images: array<struct<resource: struct<`@id`: string, service: variant>>>>>>>"
_V3 = "items array<struct<type: string, label: variant, items: array<struct<type: string, items: array<struct<type: string, motivation: string, body: struct<id: string, type: string, service: variant>>>>>>>"


def _label(v: Column) -> Column:
    """A text, the first of a list, or of a language map the value for none, pl, en or any, in that order."""
    get = lambda path: F.try_variant_get(v, path, "string")
    first = F.element_at(F.map_values(F.try_variant_get(v, "$", "map<string,array<string>>")), 1)
    plain = F.when(F.schema_of_variant(v) == "STRING", get("$"))
    return F.coalesce(plain, get("$[0]['@value']"), get("$[0]"), get("$['@value']"), get("$.none[0]"), get("$.pl[0]"), get("$.en[0]"), F.element_at(first, 1))


def _service(v: Column) -> Column:
    get = lambda path: F.try_variant_get(v, path, "string")
    return F.coalesce(get("$['@id']"), get("$.id"), get("$[0]['@id']"), get("$[0].id"))


def flatten_iiif_manifest(df: DataFrame, key: str = "manifest_id", data: str = "data") -> DataFrame:
    """(key, page_no, label, image_url, service_url) of the canvases with an image, page_no from 1; duplicate labels numbered."""
    v2 = df.select(key, F.from_json(data, _V2).alias("m")).where("m.sequences is not null")
    v2 = v2.select(key, F.posexplode(F.flatten(F.transform("m.sequences", lambda s: s["canvases"]))).alias("at", "c"))
    v2 = v2.select(key, "at", _label(F.col("c.label")).alias("label"), F.col("c.images")[0]["resource"].alias("b"))
    v2 = v2.select(key, "at", "label", F.col("b.@id").alias("image_url"), _service(F.col("b.service")).alias("service_url"))
    v3 = df.select(key, F.from_json(data, _V3).alias("m")).where("m.items is not null").select(key, F.posexplode("m.items").alias("at", "c")).where("c.type = 'Canvas'")
    notes = F.flatten(F.transform(F.filter("c.items", lambda p: p["type"] == "AnnotationPage"), lambda p: F.coalesce(p["items"], F.array())))
    image = F.filter(notes, lambda a: (a["type"] == "Annotation") & (a["motivation"] == "painting") & (a["body"]["type"] == "Image"))
    v3 = v3.select(key, "at", _label(F.col("c.label")).alias("label"), F.try_element_at(image, F.lit(1))["body"].alias("b"))
    v3 = v3.select(key, "at", "label", F.col("b.id").alias("image_url"), _service(F.col("b.service")).alias("service_url"))
    rows = v2.unionByName(v3).where("image_url is not null")
    rows = rows.withColumn("page_no", F.row_number().over(Window.partitionBy(key).orderBy("at")))
    rows = rows.withColumn("label", F.coalesce("label", F.concat(F.lit("page_"), F.col("page_no").cast("string"))))
    return unique_labels(rows, [key]).select(key, "page_no", "label", "image_url", "service_url")


def scan_page_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "tiff", "bmp")) -> DataFrame:
    """(name, path, length) of non-empty files (images, if not told otherwise) by extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    fine = name.rlike(rf"(?i)\.({'|'.join(extensions)})$") & (F.col("length") > 0)
    return files.where(fine).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("name"), "path", "length")


_HEADING = r"^\s*(?:(?:\d+\.\s*)?Example\s+(\d+)(.*)|\d+\.\s*(Original OCR|Fixed by human).*)$"


def eval_pairs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, source, ocr, ref) from numbered lines of headed text; pairs with a blank side are dropped.

    Headings: `Example N source`, `N. Original OCR`, `N. Fixed by human`.
    """
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    part = lambda i: F.nullif(F.regexp_extract("value", _HEADING, i), F.lit(""))
    head = F.col("value").rlike(_HEADING)
    starts = part(1).isNotNull()
    t = lines.withColumn("n", F.last(part(1).cast("int"), ignorenulls=True).over(w)).withColumn("source", F.last(F.when(starts, F.trim(F.regexp_extract("value", _HEADING, 2))), ignorenulls=True).over(w))
    t = t.withColumn("state", F.last(F.when(starts, "none").otherwise(part(3)), ignorenulls=True).over(w)).where(~head)
    body = lambda state: trim_all(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("state") == state, F.struct("line_no", "value")))), lambda x: x["value"]), "\n"))
    out = t.where("n is not null").groupBy(*keys, "n").agg(F.first("source").alias("source"), body("Original OCR").alias("ocr"), body("Fixed by human").alias("ref"))
    return out.where(~blank(F.col("ocr")) & ~blank(F.col("ref")))


def read_eval_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation pairs of a text file, or of each file of a folder."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = text.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return eval_pairs(lines, ["file"]).drop("file")


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Header CSV; with bom the first column's name of each part starts with the UTF-8 byte order mark."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def export_rows(projects: DataFrame, pages: DataFrame) -> DataFrame:
    """(project_id, project_name, image_name, text) of pages with text, for a sink; order by project and page."""
    p = projects.select("project_id", F.col("name").alias("project_name"))
    kept = pages.where(~blank(F.col("text")))
    return kept.join(p, "project_id").select("project_id", "project_name", F.col("name").alias("image_name"), "text", "page_id").orderBy("project_id", "page_id").drop("page_id")


def export_table(df: DataFrame, structure: list[ColumnSpec], dictionaries: dict[str, DataFrame], key: str | None = None) -> DataFrame:
    """Visible columns as text, dictionary values replaced by export values.

    Selects and numbers without a parent: by value, else by label, else as they are. Automatic columns: of the parent's
    value the export value, else the label, else N/A. Lists: each item by its value, joined by ', '; key names a column
    that tells rows apart, which is needed for them.
    """
    out = df
    for s in structure:
        d = dictionaries.get(s.dictionary) if s.dictionary else None
        if d is None:
            continue
        if s.type in ("select", "number") and s.parent is None and s.name in df.columns:
            looked = dict_lookup(out.withColumnRenamed(s.name, "_cell"), d, "_cell")
            out = looked.drop("_cell", "_cell_display").withColumnRenamed("_cell_export", s.name)
        elif s.type == "automatic" and s.parent in df.columns:
            told = d.withColumn("label", F.coalesce(nonblank(F.col("export_value").cast("string")), "label"))
            raw = out.drop(s.name).join(df.select(key, F.col(quoted(s.parent)).alias("_parent")), key) if key else out.drop(s.name).withColumn("_parent", F.col(quoted(s.parent)))
            out = automatic_column(raw, told, "_parent", s.name).drop("_parent")
        elif s.type == "list" and s.name in df.columns:
            if key is None:
                raise ValueError("lists need a column that tells rows apart")
            told = d.withColumn("label", F.coalesce(nonblank(F.col("export_value").cast("string")), "value"))
            out = list_lookup(out.withColumnRenamed(s.name, "_list"), told, "_list", key, s.name).drop("_list")
    named = [s for s in structure if s.visible and s.name in out.columns]
    return out.select(*([key] if key and key not in [s.name for s in named] else []), *(F.col(quoted(s.name)).cast("string").alias(s.name) for s in named))


def export_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*(quoted(c) for c in df.columns))).alias("value"))


