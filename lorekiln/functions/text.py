"""Column expressions on texts, tags and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_tags(tags: Column) -> Column:
    """The tags of a JSON array; null for null, empty or unreadable text and for JSON that is no array."""
    return F.when(F.trim(tags).startswith("["), F.from_json(tags, "array<string>"))


def has_all(tags: Column, wanted: list[str]) -> Column:
    """Every wanted tag is there, exactly; an empty list passes."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), tags)) == 0, F.lit(False))


def tag_like(tags_json: Column, tag: str) -> Column:
    """The compatible match of a tag inside JSON text: letter case and wildcards leak through, as LIKE has it."""
    return F.coalesce(F.lower(tags_json).like(f'%"{tag.lower()}"%'), F.lit(False))


def union_tags(old: Column, new: Column) -> Column:
    """Old tags first, then new ones not yet there."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(old, none), F.coalesce(new, none))


def uuid_of(col: Column) -> Column:
    """The canonical spelling of a UUID however written, null if it is none."""
    d = F.regexp_replace(F.lower(F.regexp_replace(col, r"[\s{}()-]+", "")), "^urn:uuid:", "")
    parts = [F.substring(d, *p) for p in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(d.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts))


def title_of(text: Column) -> Column:
    """The first 80 characters."""
    return F.substring(text, 1, 80)


def text_or_entities(raw: Column, values: Column, id_: Column) -> Column:
    """Raw text and entity values joined by a space, else the id: what is embedded for a record."""
    parts = F.filter(F.concat(F.array(raw), F.coalesce(values, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.nullif(F.array_join(parts, " "), F.lit("")), id_)
