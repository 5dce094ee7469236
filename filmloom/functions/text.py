"""Manifest cells, flags, names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The words the manifest accepts.
NULL_WORDS = ["", "nan", "na"]
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]
LENIENT_TRUE_WORDS = ["true", "1", "yes", "y"]
VIDEO_HOSTS = ["youtube.com", "youtu.be"]
DECIMAL_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
NOT_IN_ARCHIVE_NAME = "[^A-Za-z0-9._-]+"
WHITESPACE = " \t\n\r\f\u000b"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def null_like_default(col: Column, default: Column | str) -> Column:
    """The stripped text, or ``default`` for null, empty, ``nan`` and ``na`` in any case."""
    default = F.lit(default) if isinstance(default, str) else default
    text = strip(col.cast("string"))
    return F.when(col.isNull() | F.lower(text).isin(NULL_WORDS), default).otherwise(text)


def checked_bool(col: Column) -> Column:
    """true/false for the five words each; null for anything else."""
    word = F.lower(col)
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def bool_error(col: Column, key: str) -> Column:
    """An error text where :func:`checked_bool` finds no boolean."""
    return F.when(
        checked_bool(col).isNull(), F.concat(F.lit(f"invalid boolean for {key}: "), col)
    )


def strict_bool(col: Column, key: str) -> Column:
    """Like :func:`checked_bool`, but the query fails on the first bad cell."""
    return F.coalesce(checked_bool(col), F.raise_error(bool_error(col, key)).cast("boolean"))


def lenient_flag(col: Column) -> Column:
    return F.coalesce(F.lower(strip(col)).isin(LENIENT_TRUE_WORDS), F.lit(False))


def decimal_number(col: Column) -> Column:
    """A double for plain decimal text, else null (no type suffixes, no special words)."""
    text = strip(col)
    return F.when(text.rlike(DECIMAL_NUMBER), text.try_cast("double"))


def checked_scale(col: Column, low: float = 1.0, high: float = 4.0) -> Column:
    """The number where it lies in the closed range, else null."""
    number = decimal_number(col)
    return F.when(number.between(low, high), number)


def input_kind(col: Column) -> Column:
    hosts = F.lit(False)
    for host in VIDEO_HOSTS:
        hosts = hosts | col.contains(host)
    return F.when(hosts, "youtube").otherwise("path")


def is_pending(status: Column, url: Column) -> Column:
    """Work still to do: not marked yes, and a web address. Errors stay pending."""
    done = F.lower(strip(F.coalesce(status, F.lit("")))) == "yes"
    return ~done & strip(F.coalesce(url, F.lit(""))).startswith("http")


def number_in(col: Column, pattern: str, default: int) -> Column:
    """The first group of ``pattern`` as a number, or ``default`` where it is missing."""
    return F.coalesce(F.regexp_extract(col, pattern, 1).try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_archive_name(url: Column, name: Column, limit: int = 80) -> Column:
    base = F.coalesce(F.nullif(url, F.lit("")), F.nullif(name, F.lit("")), F.lit("video"))
    slug = F.btrim(F.regexp_replace(base, NOT_IN_ARCHIVE_NAME, "_"), F.lit("_"))
    slug = F.when(slug == "", "video").otherwise(F.left(slug, F.lit(limit)))
    return F.concat(slug, F.lit("_"), name)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


# Whatever is neither a Latin letter nor a decimal digit nor one of ``_-.``.
NOT_IN_LATIN_NAME = r"(?s)(?![_.\-]|\p{Nd}|(?=\p{IsLatin})\p{L})."


def latin_file_name(col: Column, stamp: str, limit: int = 32) -> Column:
    """Latin letters, digits and ``_-.`` of the NFKC base name, a stamp, and a short hash.

    Spark has no Unicode normalization: that step alone is an Arrow UDF, and it is given only
    the rows that are not plain ASCII, which no normal form changes.
    """
    base = F.substring_index(col, "/", -1)
    other = F.when(F.length(base) < F.octet_length(base), base)
    name = F.coalesce(_nfkc(other), base)
    kept = F.left(F.regexp_replace(name, NOT_IN_LATIN_NAME, ""), F.lit(limit))
    return F.concat(kept, F.lit(f"_{stamp}_"), F.left(F.sha1(name.cast("binary")), F.lit(8)))
