"""Table structures: ordered column descriptions that schemas, imports, validation and conversion are derived from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import blank, is_float, is_folio, is_integer, lev_label, nonblank

_TYPES = {"number": T.DoubleType(), "sequence": T.LongType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class ColumnSpec:
    """One column: its type (number, boolean, text, sequence, select, list, automatic, computed) and its rules."""

    name: str
    display: str
    type: str = "text"
    default: object = None
    required: bool = False
    rule: str | None = None  # integer, number, folio or sequence
    dictionary: str | None = None
    key: str | None = None
    shown: str | None = None
    export: str | None = None
    parent: str | None = None
    lookup: str | None = None
    options: tuple[str, ...] | None = None
    visible: bool = True
    #: Functions that return Columns: the value from the row's columns; a message for a value that is wrong (null if fine);
    #: what is shown of a value.
    compute: Callable[[], Column] | None = None
    check: Callable[[Column], Column] | None = None
    shown_as: Callable[[Column], Column] | None = None

    @property
    def data_type(self) -> T.DataType:
        return _TYPES.get(self.type, T.StringType())

    @property
    def derived(self) -> bool:
        return self.type in ("automatic", "computed")


def columns(text: str) -> list[ColumnSpec]:
    """Column descriptions, one a line: name | display | type | further settings as key=value."""
    out = []
    for line in text.strip().splitlines():
        name, display, kind, *more = (x.strip() for x in line.split("|"))
        settings: dict[str, object] = dict(x.split("=", 1) for x in (more[0].split() if more else []))
        if "dict" in settings:
            file, *cols = str(settings.pop("dict")).split(":")
            default_key = "name" if kind in ("select", "list") else "id"
            key, shown, export = (cols or [default_key, "name" if kind in ("select", "list") else "text", default_key])[:3]
            settings |= {"dictionary": file, "key": key, "shown": shown, "export": export}
        if "options" in settings:
            settings["options"] = tuple(str(settings["options"]).split(","))
        settings["required"] = settings.pop("required", "") == "yes"
        if "default" in settings:
            settings["default"] = str(settings["default"]).strip('"')
        out.append(ColumnSpec(name, display, kind, **settings))  # type: ignore[arg-type]
    return out


# Names, labels, types and rules of the three known table structures.
CONTENT = columns(
    """
id | ID | number | rule=integer
manuscript_id | Manuscript ID | number | rule=number
formula_id | Formula ID | number | rule=number dict=formulas.csv:id:id:id lookup=formula_text_from_ms
formula_text_from_ms | Formula Text from MS | text
formula_standardized | Formula Standardized | automatic | parent=formula_id dict=formulas.csv:id:text:text
levenshtein | Levenshtein similarity | computed
similarity_by_user | Similarity by User | select | default="" options=,0,0.5,1
sequence_in_ms | Sequence in MS | sequence | required=yes rule=sequence
where_in_ms_from | Where in MS From | text | default=""
where_in_ms_to | Where in MS To | text | default=""
rite_name_from_ms | Rubric Name from MS | text | default=""
subrite_name_from_ms | Subrubric Name from MS | text | default=""
rite_id | Rubric ID | number | rule=number dict=rite_names.csv:id:id:id lookup=rite_name_from_ms
rite_name_standarized | Rubric Name Standarized | automatic | parent=rite_id dict=rite_names.csv:id:text:text
rite_sequence_in_the_MS | Rubric Sequence in MS | number | default="" rule=integer
original_or_added | Original or Added | select | default="" options=,ORIGINAL,ADDED
biblical_reference | Biblical Reference | text | default=""
reference_to_other_items | Reference to Other Items | text | default=""
edition_index | Edition Index | text | default=""
edition_subindex | Edition Subindex | text | default=""
comments | Comments | text | default=""
function_id | Function ID | select | default="" dict=functions.csv
subfunction_id | Subfunction ID | select | default="" dict=functions.csv
liturgical_genre_id | Liturgical Genre ID | select | default="" dict=liturgical_genres.tsv
music_notation_id | Music Notation ID | select | default="" dict=music_notation.tsv
quire_id | Quire ID | number | default="" rule=integer
section_id | Section ID | select | default="" dict=sections.tsv
subsection_id | Subsection ID | select | default="" dict=sections.tsv
contributor_id | Contributor ID | text | default=""
entry_date | Entry Date | text | default=""
digital_page_number | Digital Page Number | number | default=""
proper_texts | Proper Texts | boolean | default=""
layer | Layer | select | dict=layer.tsv:short_name:name:short_name
mass_hour | Mass/Hour | select | dict=mass_hour.tsv:short_name:name:short_name
genre | Genre | select | dict=genre.tsv:short_name:name:short_name
season_month | Season/Month | select | dict=season_month.tsv:short_name:name:short_name
week | Week | select | dict=week.tsv:short_name:name:short_name
day | Day | select | dict=day.tsv:short_name:name:short_name
text_standarization__usu_id | USU id | text
"""
)
USUARIUM = columns(
    """
TYPE | TYPE | select | dict=type.tsv:short_name:name:short_name
PART | PART | select | dict=part.tsv:short_name:name:short_name
SEASON/MONTH | SEASON/MONTH | select | dict=season_month.tsv:short_name:name:short_name
WEEK | WEEK | select | dict=week.tsv:short_name:name:short_name
DAY | DAY | select | dict=day.tsv:short_name:name:short_name
FEAST | FEAST | text
COMMUNE/VOTIVE | COMMUNE/VOTIVE | select | dict=commune_votive.tsv:short_name:name:short_name
TOPICS | TOPICS | list | dict=topic.tsv:name:name:name
MASS/HOUR | MASS/HOUR | select | dict=mass_hour.tsv:short_name:name:short_name
CEREMONY | CEREMONY | select | dict=ceremony.tsv:name:name:name
MODULE | MODULE | text
SEQUENCE | SEQUENCE | number | rule=number
RUBRICS | RUBRICS | text
LAYER | LAYER | select | dict=layer.tsv:short_name:name:short_name
GENRE | GENRE | select | dict=genre.tsv:short_name:name:short_name
SERIES | SERIES | text
ITEM | ITEM | text | required=yes
STANDARD ITEM | STANDARD ITEM | text
EXPLICIT | EXPLICIT | text
PAGE NUMBER (DIGITAL) | PAGE NUMBER (DIGITAL) | number | required=yes rule=integer
PAGE NUMBER (ORIGINAL) | PAGE NUMBER (ORIGINAL) | text | required=yes
PAGE LINK | PAGE LINK | text
REMARK | REMARK | text
MADE BY | MADE BY | text
EDITION NUMBER | EDITION NUMBER | number | rule=number
_global_sequence | _global_sequence | sequence | required=yes rule=sequence
"""
)
CANTUS = columns(
    """
field_folio | Folio | text | rule=folio
field_sequence | Sequence | sequence | required=yes rule=sequence
field_office | Office | select | dict=cantus_office.tsv:key:label:key
field_genre | Genre | select | dict=cantus_genre.tsv:name:name:name
field_position | Position | text
field_cantus_id | Cantus ID | text | dict=cantus_ids.csv:id:id:id lookup=field_full_text_original
field_full_text | Full text | automatic | parent=field_cantus_id dict=cantus_ids.csv:id:text:text
field_full_text_original | Fulltext Original | text
field_feast | Feast | select | dict=cantus_feasts.tsv:key:label:key
field_mode | Mode | text
field_differentia | Differentia | text
field_finalis | Finalis | text
field_rubrics | Rubrics | text
field_differentia_database | Differentia Database | text
field_marginalia | Marginalia | select | dict=cantus_marginalia.tsv:key:label:key
field_notes_chant | Notes | text
field_imageref_from_chant | Image | number | rule=number
field_image_link | External Image Link | text
field_melody | Melody | text
field_melody_id | Melody ID | text
"""
)
STRUCTURES = {"content": CONTENT, "usuarium": USUARIUM, "cantus": CANTUS}


def quoted(name: str) -> str:
    return f"`{name}`"


def schema(structure: list[ColumnSpec]) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.data_type, True) for c in structure])


def conform(df: DataFrame, structure: list[ColumnSpec], keep: tuple[str, ...] = (), visible_only: bool = False) -> DataFrame:
    """df's columns of the structure in its order, missing or blank ones with their default; keep: columns kept in front."""
    out: list[Column] = [F.col(quoted(k)) for k in keep]
    for c in structure:
        if visible_only and not c.visible:
            continue
        value = F.col(quoted(c.name)) if c.name in df.columns else F.lit(None)
        if c.name in df.columns and dict(df.dtypes)[c.name] == "string":
            value = nonblank(value)
        default = F.lit(c.default).try_cast(c.data_type) if c.default is not None else F.lit(None)
        out.append(F.coalesce(value.try_cast(c.data_type) if c.name in df.columns else value, default).cast(c.data_type).alias(c.name))
    return df.select(*out)


def computed(df: DataFrame, structure: list[ColumnSpec]) -> DataFrame:
    """df with the columns that compute their value, in the structure's order, so that one may read those before it."""
    for c in structure:
        if c.compute is not None:
            df = df.withColumn(c.name, c.compute().cast(c.data_type))
    return df


def displayed(df: DataFrame, structure: list[ColumnSpec]) -> DataFrame:
    """df's columns of the structure as they are shown."""
    cells = {c.name: c.shown_as(F.col(quoted(c.name))) if c.shown_as else F.col(quoted(c.name)) for c in structure if c.name in df.columns}
    return df.select(*(cells.get(n, F.col(quoted(n))).alias(n) for n in df.columns))


def compute_similarity(df: DataFrame, a: str = "formula_text_from_ms", b: str = "formula_standardized", out: str = "levenshtein") -> DataFrame:
    return df.withColumn(out, lev_label(F.col(quoted(a)), F.col(quoted(b))))


def rule_error(spec: ColumnSpec) -> Column | None:
    """Message for a value of the column that breaks its rule, else null; None for columns without a rule."""
    value = F.col(quoted(spec.name)).cast("string")
    fine = {
        "integer": is_integer(F.regexp_replace(value, r"\.0$", "")),
        "sequence": is_integer(F.regexp_replace(value, r"\.0$", "")),
        "number": is_float(value),
        "folio": is_folio(value),
    }
    message = {"integer": "Must be an integer", "sequence": "Must be an integer", "number": "Must be a number", "folio": "Invalid folio"}
    out = F.lit(None).cast("string")
    if spec.rule:
        out = F.when(~fine[spec.rule], message[spec.rule])
    if spec.check:
        out = F.coalesce(out, spec.check(F.col(quoted(spec.name))))
    if spec.required:
        out = F.when(blank(value), "Must not be empty").otherwise(out)
    return out if spec.rule or spec.check or spec.required else None
