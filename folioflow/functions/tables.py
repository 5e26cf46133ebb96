"""Row-expanding parsers as table functions, for SQL: `FROM pages, LATERAL markup_rows(pages.text)`.

The same rules as `functions.text.parse_markup` and `sources.files.flatten_iiif_manifest`, a text at a time.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: White space: of ASCII, all separators of Unicode (none is beyond this range), and the byte order mark.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\x0b\f\r " or unicodedata.category(c)[0] == "Z") + "﻿"
KINDS = {"red": "rubric", "func": "function", "subrub": "subrubric"}
_PIECE = re.compile(r"<(red|func|subrub)>(?:([\s\S]*?)</\1>|[\s\S]*)|⏎|((?:[^<⏎]|<(?!(?:red|func|subrub)>))+)")


class MarkupRows:
    """(place, kind, text) of the parts of a marked-up text, place from 1; none for a null text."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        place = 0
        for tag, inner, plain in _PIECE.findall(text or ""):
            part = inner.strip(SPACES) if tag else plain
            if part.strip(SPACES):
                place += 1
                yield place, KINDS.get(tag, "text"), part


def _first(value) -> str | None:
    """Of a label: a text, the first of a list, or of a language map the value for none, pl, en or any."""
    if isinstance(value, list):
        value = value[0] if value else None
        return value.get("@value") if isinstance(value, dict) else value
    if isinstance(value, dict):
        ways = [value.get("@value"), *(value.get(k) for k in ("none", "pl", "en")), *value.values()]
        return next((w[0] if isinstance(w, list) else w for w in ways if w), None)
    return value


def _service(value) -> str | None:
    value = value[0] if isinstance(value, list) and value else value
    return value.get("@id") or value.get("id") if isinstance(value, dict) else None


class ManifestPages:
    """(page_no, label, image_url, service_url) of the canvases of an IIIF manifest (version 2 or 3) that have an image; equal labels numbered."""

    def eval(self, data: str) -> Iterator[tuple[int, str, str, str]]:
        try:
            manifest = json.loads(data or "")
        except ValueError:
            return
        found = [(c.get("label"), image) for c, image in self.canvases(manifest if isinstance(manifest, dict) else {}) if image.get("@id") or image.get("id")]
        labels = [_first(label) or f"page_{n}" for n, (label, _) in enumerate(found, 1)]
        often, seen = Counter(labels), Counter()
        for n, (label, (_, image)) in enumerate(zip(labels, found, strict=True), 1):
            seen[label] += 1
            yield n, f"{label}_{seen[label]}" if often[label] > 1 else label, image.get("@id") or image.get("id"), _service(image.get("service"))

    def canvases(self, manifest: dict) -> Iterator[tuple[dict, dict]]:
        for sequence in manifest.get("sequences") or []:
            for c in sequence.get("canvases") or []:
                yield c, ((c.get("images") or [{}])[0] or {}).get("resource") or {}
        for c in manifest.get("items") or []:
            if c.get("type") == "Canvas":
                notes = (a for p in c.get("items") or [] if p.get("type") == "AnnotationPage" for a in p.get("items") or [])
                images = (a["body"] for a in notes if a.get("type") == "Annotation" and a.get("motivation") == "painting" and (a.get("body") or {}).get("type") == "Image")
                yield c, next(images, {})


def register(spark: SparkSession) -> None:
    """`markup_rows(text)` and `manifest_pages(data)` as table functions of the session."""
    spark.udtf.register("markup_rows", udtf(MarkupRows, returnType="place int, kind string, text string", useArrow=True))
    spark.udtf.register("manifest_pages", udtf(ManifestPages, returnType="page_no int, label string, image_url string, service_url string", useArrow=True))
