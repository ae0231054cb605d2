"""Keys and small text rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillspark.model import UNKNOWN_MERCHANT

# The characters a browser trims.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_blank(text: Column) -> Column:
    """Trims; a text that starts and ends with a printable ASCII sign has nothing to trim.

    The last sign is looked up as a byte: for the last character Spark walks the whole text.
    """
    last = F.substring(text.cast("binary"), -1, 1)
    tight = (text >= "!") & (text < "\x7f") & last.between(F.lit(b"!"), F.lit(b"~"))
    return F.when(tight, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def blank_to_null(text: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(text, F.lit(""))


def category_key(category: Column) -> Column:
    return F.coalesce(blank_to_null(category), F.lit("other"))


def merchant_key(normalized: Column, raw: Column) -> Column:
    return F.coalesce(blank_to_null(normalized), blank_to_null(raw), F.lit(UNKNOWN_MERCHANT))


def product_key(normalized: Column, raw: Column) -> Column:
    """Trimmed product name; blank when there is none."""
    return trim_blank(F.coalesce(blank_to_null(normalized), raw, F.lit("")))


def cut(text: Column, length: int = 300) -> Column:
    return F.left(text, F.lit(length))


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[a-f0-9]{64}\z"), F.lit(False))


def is_currency(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[A-Za-z]{3}\z"), F.lit(False))


def canonical_json(text: Column) -> Column:
    """Sorted keys and no blanks, for payloads without a declared schema.

    Numbers take Spark's shortest form, so ``1.0`` and ``1`` are the same document here.
    """
    return F.to_json(F.try_parse_json(text))
