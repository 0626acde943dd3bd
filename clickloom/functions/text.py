"""Text column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Punctuation removed from a search query, full-width and half-width, and the space.
QUERY_PUNCTUATION = "，。！？、；：“”‘’（）《》【】{}—…￥·~！@#￥%&*+|:\"<>?`[]\\;',./ "


def strip_punctuation(col: Column) -> Column:
    return F.translate(col, QUERY_PUNCTUATION, "")


def normalize_query(col: Column) -> Column:
    """Query without listed punctuation and spaces, in lower case."""
    return F.lower(strip_punctuation(col))


def paren_text(col: Column) -> Column:
    """Text inside the last parenthesis pair (half or full width), else the text itself."""
    plain = F.translate(col, "（）", "()")
    found = F.regexp_extract(plain, r"\(([^()]*)\)[^()]*$", 1)
    return F.when(found != "", found).otherwise(col)


def last_segment(col: Column) -> Column:
    """Last segment of a URI path, with its slash."""
    return F.concat(F.lit("/"), F.substring_index(col, "/", -1))


def strip_fence(col: Column) -> Column:
    """Text without a surrounding markdown code fence."""
    return F.regexp_replace(col, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")


def parse_fenced_json(col: Column, schema: T.DataType | str) -> Column:
    """JSON inside an optional code fence; null where it does not parse."""
    return F.from_json(strip_fence(col), schema)


def clean_nan(col: Column) -> Column:
    """Rendered text where the word nan means nothing was there."""
    return F.regexp_replace(col, r"\bnan\b", "")


def pieces(col: Column) -> Column:
    """Default token pieces: runs of letters, of digits, and single other signs."""
    return F.regexp_extract_all(col, F.lit(r"(\p{L}+|\p{N}+|[^\s\p{L}\p{N}])"), 1)


def words(col: Column) -> Column:
    """Non-empty tokens split on white space."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def ngrams_of(text: Column, low: int, high: int) -> Column:
    """All character n-grams of a text, from one regex pass per length; a match moves on by one character."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), 1) for n in range(low, high + 1)])

