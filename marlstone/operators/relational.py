"""Sorting, paging, aggregates and lookups with this engine's rules, on top of the DataFrame API."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import Filter, all_of

LARGEST_PAGE, USUAL_PAGE = 1000, 50


def order_keys(keys: Iterable[str | tuple[str, str] | Column]) -> list[Column]:
    """Sort columns from names, (name, "asc" or "desc") or columns; nulls come last in either direction."""
    out = []
    for key in keys:
        if isinstance(key, Column):
            out.append(key)
            continue
        name, way = (key, "asc") if isinstance(key, str) else key
        out.append(F.desc_nulls_last(name) if way.lower() == "desc" else F.asc_nulls_last(name))
    return out


def ordered(df: DataFrame, *keys) -> DataFrame:
    return df.orderBy(*order_keys(keys))


def top(df: DataFrame, n: int, *keys, offset: int = 0) -> DataFrame:
    """The first ``n`` rows after ``offset`` by ``keys``: each task keeps its first ``n + offset``."""
    out = df.orderBy(*order_keys(keys))
    return (out.offset(offset) if offset else out).limit(n)


def first_rows(df: DataFrame, n: int, key: str, offset: int = 0) -> DataFrame:
    """A limit without an order means primary-key order, so that it has one result."""
    return top(df, n, key, offset=offset)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The rows with ``key = value``: a filter that reaches the files' statistics."""
    return df.filter(F.col(key) == F.lit(value))


def query(df: DataFrame, filters: Iterable[Filter | Column] = (), limit: int | None = None, key: str | None = None) -> DataFrame:
    """Rows that pass all filters; a limit applies afterwards, to their order by ``key``, else by the first column."""
    out = df.filter(all_of(filters))
    return out if limit is None else first_rows(out, limit, key or df.columns[0])


@dataclass
class Page:
    rows: DataFrame
    page: int
    page_size: int
    total_rows: int
    total_pages: int


def page_rows(df: DataFrame, key: str, page: int = 1, page_size: int = USUAL_PAGE, sort_by: str | None = None, descending: bool = False, filters: Iterable[Filter] = ()) -> DataFrame:
    """One page of the rows that pass ``filters``, by ``sort_by`` and then by ``key``. A page has 1 to 1000 rows."""
    size = min(max(1, page_size), LARGEST_PAGE)
    keys = [(sort_by or key, "desc" if descending else "asc")] + ([key] if sort_by and sort_by != key else [])
    return top(query(df, filters), size, *keys, offset=(max(1, page) - 1) * size)


def find_page(df: DataFrame, key: str, page: int = 1, page_size: int = USUAL_PAGE, **options) -> Page:
    """:func:`page_rows` with totals, which count the rows that pass the filters."""
    size = min(max(1, page_size), LARGEST_PAGE)
    total = query(df, options.get("filters", ())).count()
    return Page(page_rows(df, key, page, size, **options), max(1, page), size, total, math.ceil(total / size))


def total(column: str | Column) -> Column:
    """A sum that is 0 where there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0))


def mean_of_all(column: str) -> Column:
    """A mean that counts nulls as 0 and has two decimals; 0 where there are no rows."""
    return F.coalesce(F.round(F.avg(F.coalesce(F.col(column), F.lit(0))), 2), F.lit(0.0))


def join_all(first: DataFrame, *others: tuple[DataFrame, Column | str | None, str]) -> DataFrame:
    """Joins in the order given: (table, condition or key or None, "inner", "left" or "cross")."""
    out = first
    for other, on, how in others:
        out = out.crossJoin(other) if how == "cross" else out.join(other, on, how)
    return out
