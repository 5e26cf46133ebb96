"""Text functions as Column expressions: repair, markup, tokens, grams, labels, page ranges."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \s and \w know ASCII only; these classes follow Unicode.
SPACE = r"[\s\p{Z}\x{FEFF}]"
WORD = r"[\p{L}\p{N}_]"
TAG = r"</?(?:red|func|subrub)>"

Rule = tuple[str, str, bool]


def _quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~<>=!:-])", r"\\\1", text)


def hit_pattern(rules: Iterable[Rule]) -> tuple[str, str, dict[str, str]]:
    """One pattern for tags and all rules (longest mistake first, whole words first among equals), characters that its matches start with but
    `<`, and what each match becomes.

    Rules that differ only in being whole-word or in their replacement cannot be told apart and are refused.
    """
    rules = [r for r in rules if (r[0] or "").strip() and (r[1] or "").strip()]
    becomes: dict[str, str] = {}
    kinds: dict[str, bool] = {}
    for mistake, replacement, whole in rules:
        if becomes.setdefault(mistake, replacement) != replacement or kinds.setdefault(mistake, whole) != whole:
            raise ValueError(f"contradicting rules for {mistake!r}")
    ordered = sorted(kinds.items(), key=lambda x: (-len(x[0]), not x[1], x[0]))
    parts = [f"(?<!{WORD}){_quote(m)}(?!{WORD})" if whole else _quote(m) for m, whole in ordered]
    firsts = "".join(sorted({_quote(m[0]) for m in kinds}))
    return "|".join([TAG, *parts]), firsts, becomes


def fix_pattern(rules: Iterable[Rule]) -> tuple[str, dict[str, str]]:
    """A pattern that cuts a text into matches of `hit_pattern` (group 1) and what lies between, and what each match becomes."""
    hits, firsts, becomes = hit_pattern(rules)
    return f"({hits})|[^<{firsts}]+|[\\s\\S]", becomes


def apply_fix_rules(text: Column, rules: Iterable[Rule]) -> Column:
    """Replace mistakes in one pass from left to right; tags stay, and what was put in is not looked at again."""
    pattern, becomes = fix_pattern(rules)
    if not becomes:
        return text
    table = F.create_map(*(F.lit(x) for kv in becomes.items() for x in kv))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    fixed = F.zip_with(whole, hit, lambda w, h: F.when(h == "", w).otherwise(F.coalesce(table[h], w)))
    return F.when(text == "", text).otherwise(F.array_join(fixed, ""))


_MARKUP = (
    r"<red>[\s\S]*?</red>|<func>[\s\S]*?</func>|<subrub>[\s\S]*?</subrub>"
    r"|<(?:red|func|subrub)>[\s\S]*|⏎|(?:[^<⏎]++|<(?!(?:red|func|subrub)>))++"
)


def parse_markup(text: Column) -> Column:
    """Marked-up text as array<struct<kind,text>>: rubric, function, subrubric (trimmed) and running text (as it is).

    An unclosed tag drops the rest; parts without any non-blank character are dropped.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_MARKUP), F.lit(0))

    def piece(x: Column) -> Column:
        out = F.lit(None).cast("struct<kind:string,text:string>")
        for tag, kind in (("red", "rubric"), ("func", "function"), ("subrub", "subrubric")):
            inner = trim_all(F.substring(x, len(tag) + 3, F.length(x) - 2 * len(tag) - 5))
            closed = x.startswith(f"<{tag}>") & x.endswith(f"</{tag}>")
            out = F.when(closed, F.struct(F.lit(kind).alias("kind"), inner.alias("text"))).otherwise(out)
        opened = x.rlike("^<(?:red|func|subrub)>")
        return F.when(opened, out).when(x != "⏎", F.struct(F.lit("text").alias("kind"), x.alias("text")))

    return F.filter(F.transform(pieces, piece), lambda p: p.isNotNull() & p["text"].rlike(f"[^\\s\\p{{Z}}\\x{{FEFF}}]"))


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def blank(col: Column) -> Column:
    """Null, empty or white space only."""
    return col.isNull() | ~col.rlike(r"[^\s\p{Z}\x{FEFF}]")


def nonblank(col: Column) -> Column:
    """The value, or null if it is blank."""
    return F.when(~blank(col), col)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, also where use has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def collapsed(text: Column) -> Column:
    """The text with runs of white space made one space, none at its ends."""
    return trim_all(F.regexp_replace(text, f"{SPACE}+", " "))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the text with white space collapsed; none if it is shorter."""
    t = collapsed(text)

    # a look-ahead takes no characters, so the matches overlap
    return F.coalesce(F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))), F.array().cast("array<string>"))


def tokenize(text: Column) -> Column:
    """White-space separated words; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda x: x != "")


def lev_similarity(a: Column, b: Column) -> Column:
    """Percent of the longer text left alike by the edit distance; null if a side is blank."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(~blank(a) & ~blank(b), (longest - F.levenshtein(a, b)) / longest * 100)


def lev_label(a: Column, b: Column) -> Column:
    return F.coalesce(F.format_string("%.2f%%", lev_similarity(a, b)), F.lit("N/A"))


def dice(shared: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * shared, (a + b).cast("double")), F.lit(0.0))


def clean_string(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "")


def cut_on_space(text: Column) -> Column:
    """(left, right): cut at the last space at or before the middle, else at the middle."""
    middle = F.floor(F.length(text) / 2).cast("int")
    head = F.substring(text, F.lit(1), middle + 1)
    space = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    at = F.when(F.locate(" ", head) > 0, space - 1).otherwise(middle)
    return F.struct(F.substring(text, F.lit(1), at).alias("left"), F.substring(text, at + 1, F.length(text)).alias("right"))


def line_count(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, "\n", -1)))


def normalise_words(text: Column) -> Column:
    """Words without tags, breaks and punctuation, in one spelling (j as i, v as u, ae as e, y as i)."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    t = F.lower(F.regexp_replace(F.replace(t, F.lit("⏎"), F.lit(" ")), r"[^\p{L}\p{N}_\s\p{Z}]", " "))
    t = F.replace(F.translate(t, "jv", "iu"), F.lit("ae"), F.lit("e"))
    return tokenize(F.translate(t, "y", "i"))


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance of two word arrays over the length of the first; words are coded as characters.

    A pair may hold about a million distinct words (all code points but the surrogates); more raise an error. An empty
    reference has rate 0 if the other is empty too, else 1.
    """
    coded = lambda words, m: F.array_join(F.transform(words, lambda w: m[w]), "")
    numbered = lambda v: F.map_from_arrays(v, F.transform(v, lambda w, i: _char(i)))
    pair = F.struct(ref.alias("r"), hyp.alias("h"), numbered(F.array_distinct(F.concat(ref, hyp))).alias("m"))
    distance = let(pair, lambda x: F.levenshtein(coded(x["r"], x["m"]), coded(x["h"], x["m"])) / F.size(x["r"]))
    return F.when(F.size(ref) > 0, distance).otherwise(F.when(F.size(hyp) > 0, 1.0).otherwise(0.0))


def _char(number: Column) -> Column:
    """A character for each number from 0: code points from U+0100 on, without the surrogates, by way of UTF-32."""
    point = number + 256
    point = F.when(point >= 0xD800, point + 0x800).otherwise(point)
    fine = F.when(point <= 0x10FFFF, point).otherwise(F.raise_error(F.lit("too many distinct words in a pair")).cast("int"))
    return F.decode(F.unhex(F.lpad(F.hex(fine), 8, "0")), "UTF-32")


def decode_byte_tokens(text: Column) -> Column:
    """Runs of <0xHH> as the UTF-8 text they spell; left as they are where they spell none."""
    runs = F.regexp_extract_all(text, F.lit(r"(?:<0x[0-9A-Fa-f]{2}>)+|[^<]+|<"), F.lit(0))
    spelled = lambda x: F.try_validate_utf8(F.unhex(F.regexp_replace(x, "<0x|>", "")).cast("string"))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^<0x[0-9A-Fa-f]{2}>"), F.coalesce(spelled(x), x)).otherwise(x)), "")


def sanitize_label(label: Column, page: Column) -> Column:
    """A file name: letters, digits, space, _ and - only, spaces as _; page_n if nothing is left."""
    kept = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"[^\p{L}\p{N} _-]", ""))
    return F.coalesce(F.nullif(F.replace(kept, F.lit(" "), F.lit("_")), F.lit("")), F.concat(F.lit("page_"), page.cast("string")))


def url_domain(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("AUTHORITY")))


def normalize_header(name: str) -> str:
    """A header name without case, white space, _ and -."""
    return re.sub(r"[\s_-]", "", name.strip().lower())


def normalized_header(name: Column) -> Column:
    """`normalize_header` of a column of names."""
    return F.regexp_replace(F.lower(name), rf"{SPACE}|[_-]", "")


def parse_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true"), True).when(t.isin("0", "false"), False)


def parse_number(text: Column) -> Column:
    """Double, or null if the text is no number."""
    n = F.trim(text).try_cast("double")
    return F.when(~F.isnan(n), n)


def is_integer(text: Column) -> Column:
    return blank(text) | F.trim(text).rlike(r"^[+-]?[0-9]+$")


def is_float(text: Column) -> Column:
    return blank(text) | parse_number(text).isNotNull()


def is_folio(text: Column) -> Column:
    return blank(text) | F.trim(text).rlike(r"^[0-9]+(\.[12])?$|^[0-9]+[rv]$")


def add_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit(prefix), text))


def strip_prefix(text: Column, prefix: str) -> Column:
    """Without the first occurrence of prefix."""
    return F.coalesce(F.regexp_replace(text, f"^([\\s\\S]*?){_quote(prefix)}", "$1"), F.lit(""))


def extract_parenthesised(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"\((\w+)\)", 1), F.lit(""))


def page_range_join(first: Column, last: Column) -> Column:
    start = F.coalesce(first, F.lit(""))
    return F.when(F.coalesce(last, F.lit("")) == "", start).otherwise(F.concat_ws(" - ", start, last))


def page_range_split(text: Column) -> Column:
    """(first, last): the first two parts at hyphens, trimmed; empty where there is none."""
    parts = F.split(F.coalesce(text, F.lit("")), "-")
    part = lambda i: F.coalesce(F.trim(F.try_element_at(parts, F.lit(i))), F.lit(""))
    return F.struct(part(1).alias("first"), part(2).alias("last"))


_TAGS = (("red", "b"), ("func", "i"), ("subrub", "u"))


def tags_to_html(text: Column) -> Column:
    for tag, html in _TAGS:
        text = F.regexp_replace(text, f"(?i)<(/?){tag}>", f"<$1{html}>")
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def html_to_tags(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?i)<(/?)strong(?:\s[^>]*)?>", "<$1b>")
    for tag, name in _TAGS:
        t = F.regexp_replace(t, rf"(?i)<(/?){name}(?:\s[^>]*)?>", f"<$1{tag}>")
    t = F.regexp_replace(t, r"(?i)<div(?:\s[^>]*)?>", "<br>")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)</div>", ""), r"(?i)<br\s*/?>", "\n")
    return F.regexp_replace(t, "(?i)&nbsp;|\\xA0", " ")


def find_replace_all(text: Column, find: str, replacement: str, ignore_case: bool = False) -> Column:
    """Literal, non-overlapping replacement from left to right; what was put in is not searched."""
    if not find:
        return text
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, ("(?iu)" if ignore_case else "") + _quote(find), literal)


def occurrences(text: Column, find: str, ignore_case: bool = False) -> Column:
    """0-based starts of the non-overlapping occurrences of a literal."""
    gaps = F.split(text, ("(?iu)" if ignore_case else "") + _quote(find), -1)

    def starts(lengths: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda s, g: s + g) + (i - 1) * len(find)
        return F.transform(F.sequence(F.lit(1), F.size(lengths) - 1), before)

    found = let(F.transform(gaps, lambda g: F.length(g)), lambda x: F.when(F.size(x) > 1, starts(x)))
    return F.coalesce(found, F.array().cast("array<int>"))


def display_value(value: Column, options: list[str] | None = None) -> Column:
    """Enumerated columns show only their options; without options booleans show as Yes, No or nothing."""
    if options is not None:
        return F.when(value.isin(*options), value).otherwise("")
    flag = parse_bool(value.cast("string"))
    return F.when(flag, "Yes").when(~flag, "No").otherwise("")


def json_get(data: Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(data), f"$['{key}']", "string")


def json_row(data: Column) -> Column:
    """A JSON object as map<string,string>; null if it is none."""
    return F.from_json(F.when(F.trim(data).startswith("{"), data), "map<string,string>")
