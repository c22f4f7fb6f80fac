"""The fields of a job that come in several forms, as typed columns.

They take the field as the reader keeps it: a plain text, or the JSON of a list or mapping.
Values of another type than the field asks for say nothing, as if they weren't there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTAINER = "struct<image:string,credentials:struct<username:string,password:string>,env:map<string,string>,ports:array<string>,volumes:array<string>,options:string>"


def _value(json: Column) -> Column:
    """A list or mapping as a variant, without the lines of mappings. A quote before the name ends no text: it would be escaped in one."""
    return F.try_parse_json(F.when(json.rlike(r"^\s*[\[{]"), F.regexp_replace(json, r'(?<=\{)"__line__":\s*\d+,?\s*', "")))


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column) -> Column:
    """A variant's text; null if it is anything else."""
    return F.when(_type(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _part(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _members(value: Column) -> Column:
    """The members of a variant's list; null if it is none."""
    return F.when(_type(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))


def _fields(value: Column) -> Column:
    """The members of a variant's mapping by name; null if it is none."""
    return F.when(_type(value).startswith("OBJECT"), F.try_variant_get(value, "$", "map<string,variant>"))


def _texts(value: Column) -> Column:
    """One text or those of a list."""
    listed = F.filter(F.transform(_members(value), _text), lambda t: t.isNotNull())
    return F.coalesce(F.when(_text(value).isNotNull(), F.array(_text(value))), listed, F.array().cast("array<string>"))


def _plain(json: Column) -> Column:
    """The field where it is a plain text."""
    return F.when(~json.rlike(r"^\s*[\[{]") | F.try_parse_json(json).isNull(), json)


def needs(json: Column) -> Column:
    """The jobs that a job waits for."""
    return F.coalesce(F.when(_plain(json).isNotNull(), F.array(json)), _texts(_value(json)))


def runs_on(json: Column) -> Column:
    """struct<labels, group>: one label, a list, or a mapping of both."""
    value = _value(json)
    labels = F.coalesce(F.when(_plain(json).isNotNull(), F.array(json)), F.when(_type(value).startswith("ARRAY"), _texts(value)), _texts(_part(value, "labels")))
    return F.when(json.isNotNull(), F.struct(labels.alias("labels"), _text(_part(value, "group")).alias("group")))


def strategy(json: Column) -> Column:
    """struct<matrix map<string, array<variant>>, fail_fast, max_parallel>: the dimensions that are lists, ``include`` and ``exclude`` like any.

    Members of a dimension are texts, whole numbers, booleans or mappings; all others go.
    """
    value = _value(json)
    fields = _fields(_part(value, "matrix"))
    lists = F.map_filter(fields, lambda _, v: F.coalesce(_type(v).startswith("ARRAY"), F.lit(False)))
    kept = lambda v: _type(v).isin("STRING", "BIGINT", "BOOLEAN") | _type(v).startswith("OBJECT")
    matrix = F.transform_values(lists, lambda _, v: F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda m: F.coalesce(kept(m), F.lit(False))))
    fast = F.when(_type(_part(value, "fail-fast")) == "BOOLEAN", F.try_variant_get(value, "$.fail-fast", "boolean"))
    many = F.when(_type(_part(value, "max-parallel")) == "BIGINT", F.try_variant_get(value, "$.max-parallel", "bigint"))
    many = F.when(many.between(0, 4294967295), many)
    return F.when(_type(value).startswith("OBJECT"), F.struct(matrix.alias("matrix"), fast.alias("fail_fast"), many.alias("max_parallel")))


def environment(json: Column) -> Column:
    """struct<name, url>; null without a name."""
    value = _value(json)
    name = F.coalesce(_plain(json), _text(_part(value, "name")))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), _text(_part(value, "url")).alias("url")))


def _bare(image: Column) -> Column:
    """A container of which only the image is said."""
    none = F.lit(None)
    return F.struct(image.alias("image"), none.alias("credentials"), F.create_map().alias("env"), F.array().alias("ports"), F.array().alias("volumes"), none.alias("options")).cast(CONTAINER)


def _container(value: Column) -> Column:
    image, user, password = _text(_part(value, "image")), _text(_part(value, "credentials.username")), _text(_part(value, "credentials.password"))
    credentials = F.when(user.isNotNull() & password.isNotNull(), F.struct(user.alias("username"), password.alias("password")))
    env = F.map_filter(F.transform_values(_fields(_part(value, "env")), lambda _, v: F.try_variant_get(v, "$", "string")), lambda _, v: v.isNotNull())
    fields = F.struct(
        image.alias("image"), credentials.alias("credentials"), F.coalesce(env, F.create_map().cast("map<string,string>")).alias("env"),
        _texts(_part(value, "ports")).alias("ports"), _texts(_part(value, "volumes")).alias("volumes"), _text(_part(value, "options")).alias("options"),
    )
    return F.when(image.isNotNull(), fields.cast(CONTAINER))


def container(json: Column) -> Column:
    """The container of a job (``CONTAINER``): an image's name, or a mapping with one; null without. Credentials need both parts."""
    return F.coalesce(F.when(_plain(json).isNotNull(), _bare(json)), _container(_value(json)))


def services(json: Column) -> Column:
    """The service containers of a job by name; a text as a service is an image."""
    one = lambda v: F.coalesce(F.when(_text(v).isNotNull(), _bare(_text(v))), _container(v))
    found = F.map_filter(F.transform_values(_fields(_value(json)), lambda _, v: one(v)), lambda _, v: v.isNotNull())
    return F.coalesce(found, F.create_map().cast(f"map<string,{CONTAINER}>"))
