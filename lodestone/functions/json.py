"""Reading loosely typed JSON by variants: a field counts only if it has the type asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """The variant; null if the text isn't JSON."""
    return F.try_parse_json(c)


def _path(name: str) -> str:
    return "$" + "".join(f"['{p}']" for p in name.split("."))


def field(v: Column, name: str) -> Column:
    """A field by its dotted path, of any type."""
    return F.try_variant_get(v, _path(name), "variant")


def _of(v: Column, name: str, kind: str, cast: str) -> Column:
    x = field(v, name)
    return F.when(F.schema_of_variant(x).startswith(kind), F.try_variant_get(x, "$", cast))


def text(v: Column, name: str) -> Column:
    return _of(v, name, "STRING", "string")


def whole(v: Column, name: str) -> Column:
    return _of(v, name, "BIGINT", "bigint")


def flag(v: Column, name: str) -> Column:
    return _of(v, name, "BOOLEAN", "boolean")


def number(v: Column, name: str) -> Column:
    x = field(v, name)
    return F.when(F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(x, "$", "double"))


def items(v: Column, name: str) -> Column:
    """The elements of an array; none if it isn't one."""
    return F.coalesce(F.try_variant_get(v, _path(name), "array<variant>"), F.array().cast("array<variant>"))


def is_object(v: Column) -> Column:
    """Told by its fields, one level deep: a schema would be made of all levels."""
    return F.try_variant_get(v, "$", "map<string, variant>").isNotNull()


def objects(v: Column, name: str) -> Column:
    return F.filter(items(v, name), is_object)


def first(v: Column, names: tuple[str, ...], read: Callable[[Column, str], Column]) -> Column:
    """What read makes of the first of the fields that is there, whatever its type."""
    out = F.lit(None)
    for n in reversed(names):
        out = F.when(field(v, n).isNotNull(), read(v, n)).otherwise(out)
    return out


def first_text(v: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that is a text with ink."""
    inked = lambda n: F.when(F.trim(text(v, n)) != "", text(v, n))
    return F.coalesce(*[inked(n) for n in names])
