"""String expressions: blanks, tokens and stable hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode white space plus the four separators that str.strip also removes.
_SPACE = r"[\s\x1c-\x1f]"
_NON_SPACE = r"(?U)[^\s\x1c-\x1f]"

TOKEN = r"[^ \t\n\r\f]+"
HASH_BITS = 52


def is_blank(text: Column) -> Column:
    """True for null, empty or white-space-only text, in the Unicode sense."""
    return ~F.coalesce(text.rlike(_NON_SPACE), F.lit(False))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, in the Unicode sense."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def strip_or_null(text: Column) -> Column:
    return F.when(~is_blank(text), strip(text))


def tokens(text: Column) -> Column:
    """White-space separated tokens of the whole text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def each(words: Column, name: str) -> Column:
    """One row per array element.

    A plain explode makes the optimiser filter on the array's size first, and so compute the array
    again for every such test; going through a zipped array does not.
    """
    return F.inline(F.arrays_zip(words.alias(name)))


def hash52(key: Column) -> Column:
    """The first 52 bits of the MD5 of a string, as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint")


def decoded_path(column: str = "_metadata.file_path") -> Column:
    """A file path as its listing has it: metadata paths come percent-encoded, with plus signs as they are."""
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def md5_fraction(key: Column) -> Column:
    """A uniform DOUBLE in [0, 1) that any SQL engine with MD5 can reproduce."""
    return hash52(key) / F.lit(float(1 << HASH_BITS))


@F.pandas_udf(T.DoubleType())
def _blake2b_fraction(keys: pd.Series) -> pd.Series:
    def one(key: str) -> float:
        digest = hashlib.blake2b(key.encode("utf-8"), digest_size=8).digest()
        return int.from_bytes(digest, "big") / 2**64

    return keys.map(one, na_action="ignore")


def blake2b_fraction(key: Column) -> Column:
    """The 64-bit BLAKE2b fraction, for subsets that must match ones drawn with that hash."""
    return _blake2b_fraction(key)


HashFraction = Callable[[Column], Column]
