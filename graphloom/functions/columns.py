"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(table: dict[str, str], key: Column) -> Column:
    """Map lookup by a small literal table; null where the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def last_segment(path: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(path, sep), -1)


def pack(*names: str) -> Column:
    """A struct usable as an ordering or payload for max_by / min_by."""
    return F.struct(*[F.col(n) for n in names])


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(8.64e10)
