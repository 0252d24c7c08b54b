"""Checks of JSON columns against a flat contract: known fields, required fields, types. Whole schemas: ``operators.contracts``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the JSON text of a value, as ``get_json_object`` gives it.
_KINDS = {"integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", "boolean": r"^(true|false)$", "string": r"(?s)^.*$"}


def contract_errors(payload: Column, fields: Mapping[str, str], required: Sequence[str] = ()) -> Column:
    """Array of what is wrong with a JSON object, empty if nothing: no field beyond ``fields`` (name to kind) is allowed.

    ``from_json`` lets unknown fields pass, so the keys are checked by themselves.
    """
    keys = F.json_object_keys(payload)
    unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in fields]))), lambda k: F.concat(F.lit("unknown field "), k))
    missing = [F.when(~F.array_contains(keys, f), f"missing field {f}") for f in required]
    value = lambda f: F.get_json_object(payload, f"$.{f}")
    wrong = [F.when(value(f).isNotNull() & ~value(f).rlike(_KINDS[kind]), f"{f} is not of type {kind}") for f, kind in fields.items()]
    found = F.filter(F.concat(unknown, F.array(*missing, *wrong, F.lit(None).cast("string"))), lambda e: e.isNotNull())
    return F.when(keys.isNull(), F.array(F.lit("not a JSON object"))).otherwise(found)
