"""Named blobs of an image, as a map from text to bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blobs() -> Column:
    """No blobs."""
    return F.create_map().cast("map<string,binary>")


def get(own: Column, key: Column) -> Column:
    """The blob of that name, or null."""
    return F.try_element_at(own, key)


def put(own: Column, key: Column, value: Column) -> Column:
    """The blobs with this one set, in place of one of that name; a null value erases."""
    rest = erase(own, key)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(key, value)))


def erase(own: Column, key: Column) -> Column:
    return F.map_filter(own, lambda k, v: k != key)


def keys(own: Column) -> Column:
    return F.array_sort(F.map_keys(own))
