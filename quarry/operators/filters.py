"""Filters over JSON metadata, compiled to one Column.

Values keep their JSON type: numbers compare with numbers (true is 1, false 0),
strings with strings bytewise; in ranges every number is below every string;
text and numbers are never equal.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EQUALITY, RANGES = ("$eq", "$ne", "$in", "$nin"), ("$lt", "$lte", "$gt", "$gte")
MOST_BYTES, MOST_KEY = 2048, 512


class FilterError(ValueError):
    pass


class _Value:
    """What stands at a path: null (also where it is missing), a number or a string."""

    def __init__(self, metadata: Column, path: str):
        v = F.try_variant_get(F.try_parse_json(metadata), path, "variant")
        kind = F.schema_of_variant(v)
        self.null = F.coalesce(kind == "VOID", F.lit(True))
        boolean = F.coalesce(kind == "BOOLEAN", F.lit(False))
        number = boolean | F.coalesce(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
        self.is_number, self.is_string = number & ~self.null, ~number & ~self.null
        self.number = F.when(boolean, F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
        self.string = F.when(F.coalesce(kind == "STRING", F.lit(False)), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))

    def equals(self, x) -> Column:
        if isinstance(x, str):
            return F.coalesce(self.is_string & (self.string == x), F.lit(False))
        return F.coalesce(self.is_number & (self.number == float(x)), F.lit(False))

    def compares(self, operator: str, x) -> Column:
        tests = {"$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b}
        below = operator in ("$lt", "$lte")
        if isinstance(x, str):
            return F.coalesce(self.is_string & tests[operator](self.string, F.lit(x)), F.lit(False)) | (self.is_number if below else F.lit(False))
        return F.coalesce(self.is_number & tests[operator](self.number, F.lit(float(x))), F.lit(False)) | (F.lit(False) if below else self.is_string)


def _scalar(x, where: str) -> None:
    if isinstance(x, (dict, list)) or not isinstance(x, (str, bool, int, float)):
        raise FilterError(f"{where}: only strings, numbers and booleans can be compared")


def _one(value: _Value, operator: str, x) -> Column:
    if operator == "$eq":
        if x is None:
            return value.null
        _scalar(x, operator)
        return value.equals(x)
    if operator == "$ne":
        if x is None:
            return ~value.null
        _scalar(x, operator)
        return ~value.equals(x)
    if operator in ("$in", "$nin"):
        if not isinstance(x, list) or not x:
            raise FilterError(f"{operator} takes a list that isn't empty")
        for y in x:
            _scalar(y, operator)
        some = reduce(lambda a, b: a | b, [value.equals(y) for y in x])
        return some if operator == "$in" else ~some
    if isinstance(x, bool) or not isinstance(x, (str, int, float)):
        raise FilterError(f"{operator} takes a string or a number")
    return value.compares(operator, x)


def compile_filter(spec: dict | None, metadata: Column | str = "metadata") -> Column | None:
    """None where there is no filter; raises FilterError where the filter isn't valid."""
    if spec is None:
        return None
    if not isinstance(spec, dict) or not spec:
        raise FilterError("a filter is an object with at least one key")
    if len(json.dumps(spec, separators=(",", ":"), ensure_ascii=False).encode()) > MOST_BYTES:
        raise FilterError(f"a filter takes at most {MOST_BYTES} bytes")
    metadata = F.col(metadata) if isinstance(metadata, str) else metadata
    parts = []
    for key, want in spec.items():
        if not key or len(key) > MOST_KEY or key.startswith("$") or '"' in key or "|" in key:
            raise FilterError(f"{key!r} can't be a key")
        value = _Value(metadata, "$." + key)
        if isinstance(want, dict) and want and all(k in EQUALITY + RANGES for k in want):
            kinds = {k in RANGES for k in want}
            if len(kinds) > 1:
                raise FilterError("ranges can't be combined with other operators")
            parts += [_one(value, k, x) for k, x in want.items()]
        else:
            parts.append(_one(value, "$eq", want))
    return reduce(lambda a, b: a & b, parts)
