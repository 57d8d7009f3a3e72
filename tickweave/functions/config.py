"""Settings held as JSON or as maps of dotted keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(col: Column | str, dotted: str) -> Column:
    """Value at ``a.b.c`` of a JSON text column."""
    return F.get_json_object(col, "$." + dotted)


def merge_settings(base: Column, override: Column) -> Column:
    """Override a map of dotted keys.

    A key is replaced by the same key; a section replaced by a plain value loses
    its members, and a plain value replaced by a section disappears.
    """
    names = F.map_keys(override)

    def clashes(k: Column) -> Column:
        return F.exists(
            names,
            lambda o: (o == k) | F.startswith(k, F.concat(o, F.lit("."))) | F.startswith(o, F.concat(k, F.lit("."))),
        )

    return F.map_concat(F.map_filter(base, lambda k, v: ~clashes(k)), override)


def set_key(settings: Column, dotted: str, value: Column) -> Column:
    return merge_settings(settings, F.create_map(F.lit(dotted), value))


def setting(settings: Column, dotted: str) -> Column:
    return F.element_at(settings, F.lit(dotted))
