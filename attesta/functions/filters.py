"""Filters given as data, {field: {operator: value}} with $and and $or, as one column that Spark can push down."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$contains": lambda c, v: c.contains(v), "$not_contains": lambda c, v: ~c.contains(v), "$regex": lambda c, v: c.rlike("(?i)" + v),
}


def where(spec: dict[str, Any] | None) -> Column:
    """The filter of a specification; None lets all rows through. A level of it has exactly one key, lists are not empty, $and and $or take two or more."""
    if spec is None:
        return F.lit(True)
    if not isinstance(spec, dict) or len(spec) != 1:
        raise ValueError(f"a filter has exactly one key: {spec!r}")
    ((key, value),) = spec.items()
    if key in ("$and", "$or"):
        if not isinstance(value, list) or len(value) < 2:
            raise ValueError(f"{key} takes two filters or more")
        return reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), map(where, value))
    if not isinstance(value, dict) or len(value) != 1:
        raise ValueError(f"a field has exactly one operator: {spec!r}")
    ((op, operand),) = value.items()
    if op in ("$in", "$nin"):
        if not operand:
            raise ValueError(f"{op} takes one value or more")
        return F.col(key).isin(*operand) if op == "$in" else ~F.col(key).isin(*operand)
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op}")
    return COMPARE[op](F.col(key), operand)


def all_of(*specs: dict[str, Any] | None) -> dict[str, Any] | None:
    """The conjunction of those filters that are given: none, the only one, or $and of them."""
    given = [s for s in specs if s]
    return None if not given else given[0] if len(given) == 1 else {"$and": given}
