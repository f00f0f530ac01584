"""Ad-hoc event payloads as VARIANT: parsed once, read with defaults, and kept whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import layouts


def parsed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The JSON text column as a VARIANT of the same name; null where it is no JSON."""
    return payloads.withColumn(column, F.try_parse_json(column))


def field(payload: Column, path: str, kind: str, default=None) -> Column:
    """A field by path; the default where it is missing, null or of a type that does not convert."""
    found = F.try_variant_get(payload, path, kind)
    return found if default is None else F.coalesce(found, F.lit(default))


def _fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs inside a struct's DDL."""
    out, depth, held = [], 0, ""
    for c in ddl.removeprefix("struct<").removesuffix(">") + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(tuple(held.split(":", 1)))
            held = ""
        else:
            held += c
    return out


def _each(items: Column, ddl: str) -> Column:
    return F.transform(items, lambda x: typed(x, ddl))


def typed(payload: Column, ddl: str, path: str = "$") -> Column:
    """The payload in a layout.  Every field is read by itself, so one of the wrong type is null and its neighbours are not."""
    columns = []
    for name, kind in _fields(ddl):
        inner = f"{path}.{name}"
        if kind.startswith("struct<"):
            there = F.try_variant_get(payload, inner, "variant")
            value = F.when(there.isNotNull() & ~F.is_variant_null(there) & F.schema_of_variant(there).startswith("OBJECT"), typed(payload, kind, inner))
        elif kind.startswith("array<struct<"):
            value = _each(F.try_variant_get(payload, inner, "array<variant>"), kind.removeprefix("array<")[:-1])
        else:
            value = F.try_variant_get(payload, inner, kind)
        columns.append(value.alias(name))
    return F.struct(*columns)


def events_of(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Payloads (VARIANT) in the event layout, with the payload itself, in which unknown fields survive."""
    return payloads.select(typed(F.col(column), f"struct<{layouts.EVENT_FIELDS}>").alias("e"), column).select("e.*", column)


def unknown_fields(payload: Column) -> Column:
    """Names of the top-level fields that the event layout does not have, sorted."""
    known = [name for name, _ in _fields(f"struct<{layouts.EVENT_FIELDS}>")]
    names = F.map_keys(F.try_variant_get(payload, "$", "map<string,variant>"))
    return F.array_sort(F.filter(names, lambda n: ~n.isin(known)))
