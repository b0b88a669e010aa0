"""Tag predicates and lookups over `map<string,string>` columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TagFilter:
    """`[~]key[=value]`: accept, or with ~ reject, tags of that key (and value)."""

    key: str
    value: str | None = None
    reject: bool = False

    @classmethod
    def parse(cls, text: str) -> TagFilter:
        body = text.removeprefix("~")
        key, eq, value = body.partition("=")
        if not key:
            raise ValueError(f"empty tag filter: {text!r}")
        return cls(key, value if eq else None, text.startswith("~"))


def significant(tags: Column, filters: list[str] | None) -> Column:
    """Whether a tag map is significant.

    No list accepts all, an empty list none. Accept filters: some tag matches one. Reject filters: some tag matches
    none of them. Both kinds in one list are an error.
    """
    if filters is None:
        return F.lit(True)
    parsed = [TagFilter.parse(f) for f in filters]
    if not parsed:
        return F.lit(False)
    if len({f.reject for f in parsed}) > 1:
        raise ValueError("a tag filter list may not mix accepting and rejecting filters")
    if not parsed[0].reject:
        tests = [F.map_contains_key(tags, f.key) if f.value is None else F.coalesce(tags[f.key] == f.value, F.lit(False)) for f in parsed]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return F.coalesce(out, F.lit(False))
    whole = [f.key for f in parsed if f.value is None]
    exact = [f for f in parsed if f.value is not None]

    def free(e: Column) -> Column:
        ok = ~e["key"].isin(whole) if whole else F.lit(True)
        for f in exact:
            ok = ok & ~((e["key"] == f.key) & (e["value"] == f.value))
        return ok

    return F.coalesce(F.exists(F.map_entries(tags), free), F.lit(False))


def holds(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def find(tags: Column, key: str) -> Column:
    """The value, or "" where the key is missing."""
    return F.coalesce(tags[key], F.lit(""))


def has_tags(tags: Column) -> Column:
    return F.coalesce(F.size(tags) > 0, F.lit(False))


def all_keys(tags: Column) -> Column:
    return F.sort_array(F.map_keys(tags))


def all_tags(tags: Column) -> Column:
    return tags


def number(value: Column, default: float | None = None) -> Column:
    """A tag value as a number, or the default."""
    parsed = value.try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def set_tag(tags: Column, key: str, value: Column) -> Column:
    """The map with a key set, whether or not it was there."""
    rest = F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def split_values(value: Column, separators: str = ";") -> Column:
    """Non-empty parts between separator characters."""
    return F.filter(F.split(value, "[" + re.escape(separators) + "]"), lambda x: x != "")


def is_multipolygon(tags: Column) -> Column:
    return find(tags, "type") == "multipolygon"


def is_boundary(tags: Column) -> Column:
    return find(tags, "type") == "boundary"
