"""Text helpers: fallbacks between fields, keys made from digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_filled(*cols: Column, default: Column | None = None) -> Column:
    """The first value that is neither NULL nor empty, else ``default`` (NULL if not given)."""
    choices = [blank_to_null(c) for c in cols]
    if default is not None:
        choices.append(default)
    return F.coalesce(*choices)


def url_hash(col: Column) -> Column:
    """Short page key: the first 12 hex digits of the SHA-256 of the address."""
    return F.substring(F.sha2(col, 256), 1, 12)


def digest_id(col: Column) -> Column:
    """A repeatable identifier in UUID form, from the text itself."""
    digest = F.md5(col)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return reduce(
        lambda left, right: F.concat(left, F.lit("-"), right),
        [F.substring(digest, start, length) for start, length in parts],
    )
