"""Predicates: typed filters, and chains of AND and OR that group to the right."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """``column operator value``; ``value2`` is the upper end of ``between``, a list is the value of ``in``."""

    column: str
    operator: str
    value: Any = None
    value2: Any = None


def _column(name: str) -> Column:
    return F.col(name)


def predicate(f: Filter) -> Column:
    """A typed filter as a column. ``like`` is a case-insensitive substring; ``ilike`` has % and _.

    ``= None`` finds nulls and ``!= None`` the rest; other comparisons with null are null, which filters drop.
    """
    c, op = _column(f.column), f.operator.lower()
    if op in ("=", "==") or op in ("!=", "<>"):
        negated = op in ("!=", "<>")
        if f.value is None:
            return c.isNotNull() if negated else c.isNull()
        return c != f.value if negated else c == f.value
    simple = {">": c.__gt__, ">=": c.__ge__, "<": c.__lt__, "<=": c.__le__}
    if op in simple:
        return simple[op](f.value)
    if op == "between":
        return c.between(f.value, f.value2)
    if op == "in":
        return c.isin(list(f.value))
    if op == "like":
        return F.contains(F.lower(c.cast("string")), F.lower(F.lit(str(f.value))))
    if op == "ilike":
        return c.ilike(f.value)
    raise ValueError(f"unknown operator: {f.operator}")


def all_of(filters: Iterable[Filter | Column]) -> Column:
    """Filters joined by AND; true if there are none."""
    columns = [x if isinstance(x, Column) else predicate(x) for x in filters]
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)


def chain(first: Filter | Column, *rest: tuple[str, Filter | Column]) -> Column:
    """``chain(a, ("and", b), ("or", c))`` is ``a AND (b OR c)``: AND and OR bind alike and group to the right."""
    terms = [("", first), *rest]
    columns = [x if isinstance(x, Column) else predicate(x) for _, x in terms]
    out = columns[-1]
    for (word, _), left in zip(reversed(terms[1:]), reversed(columns[:-1]), strict=True):
        if word.lower() not in ("and", "or"):
            raise ValueError(f"neither and nor or: {word}")
        out = left & out if word.lower() == "and" else left | out
    return out
