"""JSON schema validation compiled to column expressions.

The schema is read once, on the driver, and becomes one expression over a VARIANT,
which is parsed once a row: the path and text of the first error in the order type,
enum, required properties, properties as they stand in the text, array length, items,
string length; null if the value is valid. Unknown keywords are ignored.

Properties of objects inside arrays are taken in alphabetical order, because a VARIANT
keeps that of the text for no object, and only objects outside arrays have a path by
which their text is found. Whole numbers of more than 38 digits count as fractions.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kind(v: Column) -> Column:
    """The variant's JSON type. Whole numbers count as integers only if written so."""
    name = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), "integer")
        .when(name == "VOID", "null")
        .otherwise("number")
    )


def _fail(condition: Column, path: Column, text: str) -> Column:
    return F.when(condition, F.concat(path, F.lit(": " + text)))


def _first(errors: list[Column]) -> Column:
    return F.coalesce(*errors) if errors else F.lit(None).cast("string")


def _error(v: Column, text: Column | None, schema: dict[str, Any], path: Column) -> Column:
    """First error of a value. text: the JSON of an object as it is written, where it is known."""
    return _let(_kind(v), lambda kind: _first(_checks(v, kind, text, schema, path)))


def _members(v: Column, text: Column | None, schema: dict[str, Any], path: Column) -> Column:
    """First error among the properties that an object has and should not, or whose values are wrong."""
    properties = schema.get("properties") or {}

    def told(keys: Column) -> Column:
        errors = []
        for name, sub in properties.items():
            below = F.get_json_object(text, f"$['{name}']") if text is not None else None
            inner = _error(F.try_variant_get(v, f"$['{name}']", "variant"), below, sub, F.concat(path, F.lit("." + name)))
            errors.append(F.when(F.array_contains(keys, name), inner))
        found = F.array(*[F.struct(F.array_position(keys, n).cast("long").alias("at"), e.alias("error")) for n, e in zip(properties, errors, strict=True)])
        if schema.get("additionalProperties") is False:
            extra = F.filter(keys, lambda k: ~k.isin(*properties) if properties else F.lit(True))
            unwanted = F.transform(extra, lambda k: F.struct(F.array_position(keys, k).cast("long").alias("at"), F.concat(path, F.lit(": additional property '"), k, F.lit("' not allowed")).alias("error")))
            found = F.concat(found, unwanted) if properties else unwanted
        return F.array_min(F.filter(found, lambda x: x["error"].isNotNull()))["error"]

    known = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return _let(F.coalesce(F.json_object_keys(text), known) if text is not None else known, told)


def _checks(v: Column, kind: Column, text: Column | None, schema: dict[str, Any], path: Column) -> list[Column]:
    errors: list[Column] = []
    wanted = schema.get("type")
    if wanted is not None:
        names = [wanted] if isinstance(wanted, str) else list(wanted)
        allowed = {n for n in names} | ({"integer"} if "number" in names else set())
        errors.append(_fail(~kind.isin(*sorted(allowed)), path, f"expected type {json.dumps(wanted)}"))
    if schema.get("enum") is not None:
        values = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]
        errors.append(_fail(~F.coalesce(F.to_json(v), F.lit("null")).isin(*values), path, f"not in enum {json.dumps(schema['enum'], ensure_ascii=False)}"))
    is_object, is_array, is_string = kind == "object", kind == "array", kind == "string"
    for name in schema.get("required") or []:
        missing = ~F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), name), F.lit(False))
        errors.append(_fail(is_object & missing, path, f"missing required property {name!r}"))
    if schema.get("properties") or schema.get("additionalProperties") is False:
        errors.append(F.when(is_object, _members(v, text, schema, path)))
    if {"minItems", "maxItems", "items"} & schema.keys():
        items = F.try_variant_get(v, "$", "array<variant>")
        if "minItems" in schema:
            errors.append(_fail(is_array & (F.size(items) < schema["minItems"]), path, f"array shorter than minItems={schema['minItems']}"))
        if "maxItems" in schema:
            errors.append(_fail(is_array & (F.size(items) > schema["maxItems"]), path, f"array longer than maxItems={schema['maxItems']}"))
        if isinstance(schema.get("items"), dict):
            each = F.transform(items, lambda x, i: _error(x, None, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            errors.append(F.when(is_array, F.get(F.filter(each, lambda e: e.isNotNull()), F.lit(0))))
    if {"minLength", "maxLength"} & schema.keys():
        written = F.try_variant_get(v, "$", "string")
        if "minLength" in schema:
            errors.append(_fail(is_string & (F.length(written) < schema["minLength"]), path, f"string shorter than minLength={schema['minLength']}"))
        if "maxLength" in schema:
            errors.append(_fail(is_string & (F.length(written) > schema["maxLength"]), path, f"string longer than maxLength={schema['maxLength']}"))
    return errors


def validate_json(value: Column, schema: dict[str, Any]) -> Column:
    """First error of a JSON text, or null; text that is no JSON is an error at the root."""
    return _let(F.try_parse_json(value), lambda v: F.when(v.isNull(), F.lit("$: not valid JSON")).otherwise(_error(v, value, schema, F.lit("$"))))
