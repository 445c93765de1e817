"""Text as columns: lines, tokens, trimming, decoding, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
#: Everything that ends a line for a text reader that knows all of Unicode's separators.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85  ]"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their breaks; a final break opens no further line, an empty text has none."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_right(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def decode(content: Column) -> Column:
    """Bytes to text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def contains_literal(text: Column, query: str, case_sensitive: bool = False) -> Column:
    """Substring match; no character of the query is special."""
    return text.contains(F.lit(query)) if case_sensitive else F.lower(text).contains(F.lit(query.lower()))


def version_key(version: Column) -> Column:
    """'2.10' to [2, 10], so that versions compare as numbers; [0] for anything else."""
    parts = F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
    return F.when(version.isNull() | F.exists(parts, lambda x: x.isNull()), F.array(F.lit(0))).otherwise(parts)


def token_estimate(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("int")
