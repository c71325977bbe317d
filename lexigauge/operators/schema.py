"""JSON documents against a JSON Schema: every fault with its path, by expressions over variants.

A schema (nested dictionaries: type, enum, minimum, properties, required, additionalProperties, items) is compiled once to
a column. Objects are read as maps and arrays as arrays of variants; each level is bound to a variable, so the column grows
with the schema and not with the product of its levels.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULTS = "array<struct<path:string,fault:string>>"


def _fault(wrong: Column, path: Column, text: Column | str) -> Column:
    """An array of one fault where ``wrong`` holds, else an empty one."""
    what = F.lit(text) if isinstance(text, str) else text
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(F.struct(path.alias("path"), what.alias("fault")))).otherwise(F.array().cast(FAULTS))


def _with(value: Column, then: Any) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _type_is(kind: Column, name: str) -> Column:
    """Whether the type that Spark finds in a variant is the schema's."""
    begins = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT"}
    if name == "number":
        return kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return F.startswith(kind, F.lit(begins[name]))


def faults(value: Column, schema: dict[str, Any], path: Column) -> Column:
    """Array of (path, fault) of a variant, outer faults before inner ones; empty for a value that the schema allows.

    A value of another type is one fault and is not looked into. A null is allowed where the type says so.
    """
    declared = schema.get("type")
    allowed = declared if isinstance(declared, list) else [declared]
    name = next((t for t in allowed if t not in ("null", None)), None)
    label = " or ".join(t for t in allowed if t)

    def inside(v: Column) -> Column:
        parts: list[Column] = []
        if "enum" in schema:
            options = [x for x in schema["enum"] if x is not None]
            parts.append(_fault(~F.try_variant_get(v, "$", "string").isin(*[str(x).lower() if isinstance(x, bool) else str(x) for x in options]), path, "unsupported value"))
        if name in ("integer", "number") and "minimum" in schema:
            parts.append(_fault(F.try_variant_get(v, "$", "double") < float(schema["minimum"]), path, "below minimum"))
        if name == "object":
            parts.append(_with(F.try_variant_get(v, "$", "map<string,variant>"), members))
        if name == "array" and schema.get("items"):
            items = F.try_variant_get(v, "$", "array<variant>")
            each = F.transform(items, lambda x, i: faults(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            parts.append(F.flatten(each))
        return F.concat(*parts) if parts else F.array().cast(FAULTS)

    def members(m: Column) -> Column:
        properties: dict[str, dict] = schema.get("properties", {})
        keys, parts = F.map_keys(m), []
        if schema.get("required"):
            missing = F.array_except(F.array(*[F.lit(k) for k in sorted(schema["required"])]), keys)
            parts.append(_fault(F.size(missing) > 0, path, F.concat(F.lit("missing "), F.array_join(missing, ", "))))
        if schema.get("additionalProperties") is False:
            extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in properties]).cast("array<string>")))
            parts.append(_fault(F.size(extra) > 0, path, F.concat(F.lit("extra "), F.array_join(extra, ", "))))
        for key, own in properties.items():
            there = F.array_contains(keys, F.lit(key))
            parts.append(F.when(there, faults(F.element_at(m, F.lit(key)), own, F.concat(path, F.lit(f".{key}")))).otherwise(F.array().cast(FAULTS)))
        return F.concat(*parts) if parts else F.array().cast(FAULTS)

    def typed(v: Column) -> Column:
        if name is None:
            return inside(v)
        wrong = ~_type_is(F.schema_of_variant(v), name)
        return F.when(F.coalesce(wrong, F.lit(True)), _fault(F.lit(True), path, f"must be {label}")).otherwise(inside(v))

    def bound(v: Column) -> Column:
        return F.when(F.coalesce(F.is_variant_null(v), F.lit(True)), F.array().cast(FAULTS)).otherwise(typed(v)) if "null" in allowed else typed(v)

    return _with(value, bound)


def schema_faults(rows: DataFrame, text: str, schema: dict[str, Any], keys: list[str], root: str = "$") -> DataFrame:
    """keys, place, path, fault: every fault of the JSON text of every row, in order. Text that is no JSON, and a null, is
    one fault ``not JSON`` at the root. Rows without faults are absent; an empty table gives an empty result."""
    parsed = F.try_parse_json(F.col(text))
    found = F.when(parsed.isNull(), _fault(F.lit(True), F.lit(root), "not JSON")).otherwise(faults(parsed, schema, F.lit(root)))
    return rows.select(*keys, F.posexplode(found).alias("place", "f")).select(*keys, "place", "f.path", "f.fault")
