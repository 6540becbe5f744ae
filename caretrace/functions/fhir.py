"""Expressions over one clinical resource held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def items_at(v: Column, path: str) -> Column:
    """Array of VARIANT; NULL when the path is absent or not a list."""
    return F.try_variant_get(v, path, "array<variant>")


def present_at(v: Column, path: str) -> Column:
    """True when the key exists, whatever its value."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def coding_list(items: Column) -> Column:
    """Codings that say anything, as structs of text."""
    coded = F.transform(
        F.coalesce(items, F.array().cast("array<variant>")),
        lambda x: F.struct(
            F.coalesce(text_at(x, "$.system"), F.lit("")).alias("system"),
            F.coalesce(text_at(x, "$.code"), F.lit("")).alias("code"),
            F.coalesce(text_at(x, "$.display"), F.lit("")).alias("display"),
        ),
    )
    return F.filter(coded, lambda c: (c["system"] != "") | (c["code"] != "") | (c["display"] != ""))


def codings_at(v: Column, path: str) -> Column:
    return coding_list(items_at(v, f"{path}.coding"))


def first_coding(codings: Column) -> Column:
    return F.try_element_at(codings, F.lit(1))


def canonical_json(payload: Column) -> Column:
    """Compact JSON with sorted keys; VARIANT keeps object keys in order at every level."""
    return F.to_json(F.try_parse_json(payload))
