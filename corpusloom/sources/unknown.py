"""Keys of records that the schema doesn't know: kept beside the known ones, as VARIANT, and written back where they were."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column of what the schema lacks: path of a struct ('' is the record) -> key -> value. Structs without such keys are left out.
UNKNOWN = "_unknown"
UNKNOWN_TYPE = "map<string,map<string,variant>>"


def _structs(kind: T.StructType, path: str = "") -> list[tuple[str, T.StructType]]:
    """Each struct of a schema with its path; those inside arrays and maps have none."""
    found = [(path, kind)]
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            found += _structs(f.dataType, f"{path}.{f.name}" if path else f.name)
    return found


def unknown_keys(v: Column, schema: T.StructType) -> Column:
    """What ``v``, a VARIANT of a record, has besides the fields of ``schema``, by the path of the struct it is in."""
    known = T.StructType([f for f in schema.fields if f.name != UNKNOWN])
    entries = []
    for path, kind in _structs(known):
        own = F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".") if p), "map<string,variant>")
        entries.append(F.struct(F.lit(path).alias("key"), _besides(own, kind.names).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.coalesce(F.size(e["value"]), F.lit(0)) > 0))


def _besides(members: Column, names: list[str]) -> Column:
    return F.map_filter(members, lambda key, _: ~key.isin(*names)) if names else members


def parsed(lines: DataFrame, schema: T.StructType, line: str = "value") -> DataFrame:
    """Records of JSON texts with the fields of ``schema`` and UNKNOWN; a text that isn't a record is an error."""
    known = T.StructType([f for f in schema.fields if f.name != UNKNOWN])
    record = F.from_json(line, known, {"mode": "FAILFAST"})
    # a column of its own, so a line is parsed once and not for each struct
    both = lines.select(record.alias("r"), F.parse_json(line).alias("_v"))
    return both.select("r.*", unknown_keys(F.col("_v"), known).alias(UNKNOWN))


def without(df: DataFrame, *paths: str) -> DataFrame:
    """Forgets unknown keys of structs that have been made anew, and of all inside them."""
    if UNKNOWN not in df.columns or not paths:
        return df
    inside = lambda key: F.exists(F.array(*(F.lit(p) for p in paths)), lambda p: (key == p) | key.startswith(F.concat(p, F.lit("."))))
    return df.withColumn(UNKNOWN, F.map_filter(UNKNOWN, lambda key, _: ~inside(key)))


_OPTIONS = {"ignoreNullFields": "false"}


def _mended(kind: T.StructType, path: str, end: str, paths: list[str]) -> Column:
    """The struct at ``path`` with a last field ``end`` in it and in each struct within: the struct's number in ``paths``."""
    at = F.col(".".join(f"`{p}`" for p in path.split(".")))
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            at = at.withField(f"`{f.name}`", _mended(f.dataType, f"{path}.{f.name}", end, paths))
    return at.withField(end, F.lit(paths.index(path)))


def as_lines(df: DataFrame, out: str = "value") -> DataFrame:
    """The JSON text of each record, each struct's unknown keys last.

    The known fields are written at once, with the number of its struct at the end of each. That gives way to the
    unknown keys, of which few structs have any: no struct is written by itself.
    """
    known = T.StructType([f for f in df.schema.fields if f.name != UNKNOWN])
    if UNKNOWN not in df.columns:
        return df.select(F.to_json(F.struct(*(F.col(f"`{n}`") for n in known.names)), _OPTIONS).alias(out))
    end = f"end_{uuid.uuid4().hex}"
    paths = [path for path, _ in _structs(known)]
    fields = (_mended(f.dataType, f.name, end, paths).alias(f.name) if isinstance(f.dataType, T.StructType) else F.col(f"`{f.name}`") for f in known.fields)
    # texts are a column of their own, which is read in two places: else they would be worked out inside the lambda's function, uncompiled
    texts = df.select(F.to_json(F.struct(*fields, F.lit(0).alias(end)), _OPTIONS).alias("_text"), UNKNOWN)
    some = F.filter(F.map_entries(UNKNOWN), lambda e: F.size(e["value"]) > 0)
    number = lambda path: (F.array_position(F.array(*map(F.lit, paths)), path) - 1).cast("string")
    own = F.transform(some, lambda e: F.struct(F.concat(F.lit(f'"{end}":'), number(e["key"]), F.lit("}")).alias("end"), F.to_json(e["value"]).alias("members")))
    filled = F.aggregate(own, F.col("_text"), lambda acc, e: F.replace(acc, e["end"], F.substr(e["members"], F.lit(2))))
    text = F.when(F.size(UNKNOWN) > 0, filled).otherwise(F.col("_text"))
    comma = "," if all(kind.fields for _, kind in _structs(known)) else ",?"  # a search for a plain text is several times as fast
    return texts.select(F.regexp_replace(text, f'{comma}"{end}":[0-9]+', "").alias(out))
