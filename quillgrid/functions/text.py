"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Measuring units that mark parameter tables.
UNITS = ("mm", "kn", "mpa", "kw", "cm3", "g/s", "r/min", "℃", "%")
#: Sentence marks of long texts.
MARKS = ("。", "；", "：", ".", ";", ":")
#: Code patterns.
HYDRAULIC_CODE = r"(?U)\b(?:[A-Z]{1,3}\d+(?:\.\d+)?(?:/[A-Z]?\d+(?:\.\d+)?)?)\b"
ELECTRIC_CODE = r"(?:=[0-9A-Z+\-./]+|-[A-Z]{1,4}\d+|&[A-Z]{2,}=[0-9A-Z+\-./]+)"
TOC_CODE = r"(?U)\b\d+\.\d+(?:\.\d+)?-\d+\b"
NUMBER = r"(?U)\d+(?:\.\d+)?"
#: Patterns of table-of-contents lines, tried in this order; each gives (number group, title group).
_LEADER = r"\s*(?:[._·…-]{2,}|\s{2,})\s*([IVXLCDMivxlcdm]+|\d+(?:[.\-]\d+){0,6})\s*$"
TOC_LINES = (
    (r"^((?:\d+[.\-])*\d+)\s+(.+?)" + _LEADER, 1, 2),
    (r"^(.+?)" + _LEADER, 0, 1),
    (r"^((?:\d+[.\-])*\d+)\s*[\)\]】）\.、:\-]?\s*(.+)$", 1, 2),
    (r"^([IVXLCDMivxlcdm]+)\s*[\)\]】）\.、:\-]?\s*(.+)$", 1, 2),
    (r"^(第[一二三四五六七八九十百千万零〇两0-9]+[章节篇部卷节])\s*(.+)$", 1, 2),
)


def clean(x: Column) -> Column:
    """White space runs to one space, trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def compact(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit(""))


def keyword_hits(x: Column, keywords: tuple[str, ...]) -> Column:
    """How many keywords the text holds, in any case, with or without its spaces."""
    return hits_in(F.lower(x), compact(F.lower(x)), keywords)


def hits_in(low: Column, tight: Column, keywords: tuple[str, ...]) -> Column:
    """keyword_hits of lower-cased text, as it is and without spaces; the two as columns are computed once."""
    out = F.lit(0)
    for k in keywords:
        word = k.lower()
        held = F.contains(tight, F.lit(word.replace(" ", "")))
        out = out + ((F.contains(low, F.lit(word)) | held) if " " in word else held).cast("int")
    return out


def occurrences(x: Column, words: tuple[str, ...]) -> Column:
    """Non-overlapping occurrences of all words, case-sensitive."""
    out = F.lit(0)
    for w in words:
        out = out + ((F.length(x) - F.length(F.replace(x, F.lit(w), F.lit("")))) / len(w)).cast("int")
    return out


def long_text_signal(x: Column) -> Column:
    """min(4, length / 320 + 0.3 per sentence mark) of cleaned text of at least 180 characters, else 0."""
    return F.when(F.length(x) < 180, 0.0).otherwise(F.least(F.lit(4.0), F.length(x) / 320.0 + occurrences(x, MARKS) * 0.3))


def count_codes(x: Column, pattern: str) -> Column:
    """Matches of a code pattern."""
    return F.regexp_count(x, F.lit(pattern))


def safe_name(x: Column, most: int = 80) -> Column:
    """A path component: anything but word characters, dot and dash becomes _, ends stripped, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[^\w.\-]+", "_"), r"^[_.]+|[_.]+$", ""), 1, most)


def basename(x: Column) -> Column:
    return F.substring_index(F.replace(x, F.lit("\\"), F.lit("/")), "/", -1)


def suffix(x: Column) -> Column:
    """Lower-case extension with its dot; empty if none."""
    return F.lower(F.regexp_extract(basename(x), r"[^.](\.[^.]+)$", 1))


def stem(x: Column) -> Column:
    return F.regexp_replace(basename(x), r"(?<=[^.])\.[^.]+$", "")


def folders(x: Column) -> Column:
    """Folder names of a path, without blanks and without its last part."""
    parts = F.filter(F.transform(F.split(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def truncated(x: Column, most: int, mark: str = "...") -> Column:
    """x cut to most characters with a mark where it was longer."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(mark))).otherwise(x)


def toc_text(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.trim(F.coalesce(x, F.lit(""))), F.lit("＿"), F.lit("_")), r"\s+", " "))


def section_and_title(x: Column) -> Column:
    """struct(section_number, title) of a contents line by the first pattern that fits."""
    text = toc_text(x)
    number, title = F.lit(""), text
    for pattern, n, t in reversed(TOC_LINES):
        fits = text.rlike(pattern)
        number = F.when(fits, F.trim(F.regexp_extract(text, pattern, n)) if n else F.lit("")).otherwise(number)
        title = F.when(fits, F.trim(F.regexp_extract(text, pattern, t))).otherwise(title)
    return F.struct(number.alias("section_number"), title.alias("title"))


def page_code(x: Column) -> Column:
    """The page code at the end of a contents line, upper case; empty if none."""
    return F.upper(F.regexp_extract(F.replace(F.trim(F.coalesce(x, F.lit(""))), F.lit("＿"), F.lit("_")), _LEADER, 1))


def footer_codes(x: Column) -> Column:
    """Distinct page codes in a page's footer text, upper case."""
    found = F.lit(None).cast("array<string>")
    patterns = (r"\b\d+(?:\.\d+){1,3}-\d+\b", r"\b\d+-\d+\b", r"\b[IVXLCDMivxlcdm]+\b")
    found = F.concat(*(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(p), F.lit(0)) for p in patterns))
    return F.array_distinct(F.transform(found, F.upper))


#: Image types by extension.
MIME = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp"}


def image_mime(x: Column, default: str = "image/png") -> Column:
    """MIME type by extension."""
    return F.coalesce(*(F.when(suffix(x) == k, v) for k, v in MIME.items()), F.lit(default))


def graph_text(name: Column, description: Column) -> Column:
    """`name: description`, or the name alone."""
    return F.when(F.trim(F.coalesce(description, F.lit(""))) != "", F.concat(name, F.lit(": "), description)).otherwise(name)
