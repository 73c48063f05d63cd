"""Walks over JSON texts as VARIANT values, in expressions, to any depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(value: Column) -> Column:
    """The map of an object's fields; null for anything else."""
    return value.try_cast("map<string,variant>")


def items(value: Column) -> Column:
    """The array of a list's values; null for anything else."""
    return value.try_cast("array<variant>")


def kind(value: Column) -> Column:
    """The type of a leaf: STRING, BOOLEAN, VOID, or that of a number."""
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    return kind(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def leaves(payload: Column, state: Column, inherit: Callable[[Column, Column], Column], keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """array<struct<value variant, state>> of all leaves of a JSON text; null where it is no JSON.

    state is handed down: inherit(fields of an object, state) is what its
    fields get, and keep(key, fields) says which of them are followed.
    The walk goes level by level, at most once for each opening bracket, and
    stops working where no level is left.
    """
    node = F.struct(F.try_parse_json(payload).alias("value"), state.alias("state"))
    none = F.slice(F.array(node), 1, 0)

    def below(n: Column) -> Column:
        # inner arrays stand for "let": what is worked out once and named
        of_object = F.transform(
            F.array(F.struct(fields(n.value).alias("m"), n.state.alias("s"))),
            lambda o: F.transform(
                F.filter(F.map_entries(o.m), lambda e: keep(e.key, o.m) if keep else F.lit(True)),
                lambda e: F.struct(e.value.alias("value"), inherit(e.key, F.struct(o.m.alias("fields"), o.s.alias("state"))).alias("state")),
            ),
        )[0]
        of_list = F.transform(items(n.value), lambda v: F.struct(v.alias("value"), n.state.alias("state")))
        return F.coalesce(of_object, of_list)

    branch = lambda n: fields(n.value).isNotNull() | items(n.value).isNotNull()
    step = lambda s, _: F.when(F.size(s.open) == 0, s).otherwise(
        F.struct(F.flatten(F.transform(F.filter(s.open, branch), below)).alias("open"), F.concat(s.found, F.filter(s.open, lambda n: ~branch(n))).alias("found"))
    )
    levels = F.sequence(F.lit(0), F.size(F.regexp_extract_all(payload, F.lit(r"[\[{]"), F.lit(0))))
    start = F.struct(F.array(node).alias("open"), none.alias("found"))
    walked = F.aggregate(levels, start, step, lambda s: s.found)
    return F.when(F.try_parse_json(payload).isNotNull(), walked)


#: A step of a path: a key, or what stands in brackets behind one.
STEP = r"\[[^\]]*\]|[^.\[\]]+"


def followed(value: Column, path: Column) -> Column:
    """What a path such as a.b[name=x].c[0] leads to; null where it leads nowhere.

    A step is a key, [n] the n-th value of a list (from its end if negative),
    and [key=text] the first object whose field is that text or number.
    """

    def pick(node: Column, step: Column) -> Column:
        inside = F.substring(step, 2, 1 << 30)
        inside = F.regexp_replace(inside, r"\]$", "")
        key, wanted = F.substring_index(inside, "=", 1), F.regexp_replace(inside, "^[^=]*=", "")

        def same(item: Column) -> Column:
            field = F.try_element_at(fields(item), key)
            number = is_number(field) & (field.try_cast("double") == wanted.try_cast("double"))
            return F.coalesce((field.try_cast("string") == wanted) | number, F.lit(False))

        place = inside.try_cast("int")
        by_place = F.try_element_at(items(node), F.when(place < 0, place).otherwise(place + 1))
        by_field = F.get(F.filter(items(node), same), F.lit(0))
        by_key = F.try_element_at(fields(node), step)
        return F.when(~step.startswith("["), by_key).when(inside.contains("="), by_field).otherwise(by_place)

    return F.aggregate(F.regexp_extract_all(path, F.lit(STEP), F.lit(0)), value, pick)
