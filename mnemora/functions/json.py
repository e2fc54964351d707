"""JSON texts compared by what they say: a canonical form, and whether one contains another, on VARIANT in the JVM."""

from __future__ import annotations

import functools
import json
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(x: str | Column) -> Column:
    """A JSON text with the keys of all its objects in order and decimals without trailing zeros, so that equal values are
    equal texts. What is no JSON, or repeats a key within an object, stays as it is; null stays null.
    """
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def _step(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _contains(value: Column, pattern, top: bool) -> Column:
    kind = F.schema_of_variant(value)
    if isinstance(pattern, dict):
        fields = _step(value, "$", "map<string,variant>")  # by name, as a path cannot name every key
        keys = [_contains(F.try_element_at(fields, F.lit(k)), v, False) for k, v in pattern.items()]
        return functools.reduce(operator.and_, keys, F.startswith(kind, F.lit("OBJECT")))
    elements = F.coalesce(_step(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    if isinstance(pattern, list):
        held = [F.exists(elements, _held_by(p)) for p in pattern]
        return functools.reduce(operator.and_, held, F.startswith(kind, F.lit("ARRAY")))
    same = F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(pattern, ensure_ascii=False))))
    return (same | F.exists(elements, lambda e: F.to_json(e) == F.to_json(F.parse_json(F.lit(json.dumps(pattern, ensure_ascii=False)))))) if top else same


def _held_by(pattern):
    return lambda e: F.coalesce(_contains(e, pattern, False), F.lit(False))


def contains(x: str | Column, pattern) -> Column:
    """Whether a JSON text contains a pattern: its objects have the pattern's keys with values that contain the pattern's,
    its arrays hold, in any order, an element for each of the pattern's, and scalars are equal; a bare scalar is also
    contained in an array at the top. False for what is no JSON; null for null.
    """
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNotNull(), F.coalesce(_contains(F.try_parse_json(c), pattern, True), F.lit(False)))
