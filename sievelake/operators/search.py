"""Document search over a DataFrame.

A :class:`Search` gathers clauses and paging and turns into DataFrames: hits,
their total, and anything aggregated over all matches.  Row visibility is a
filter below everything else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import knn as vectors
from .predicates import bool_query, terms_any


def visible(df: DataFrame, groups: Sequence[str], column: str = "visibleBy") -> DataFrame:
    """Rows that one of ``groups`` may see; none without groups."""
    return df.filter(terms_any(column, list(groups)) if groups else F.lit(False))


@dataclass(frozen=True)
class Search:
    """An immutable request; every method gives a new one.

    ``size`` and ``offset`` bound the hits only; totals and aggregations see all
    matches.  Hits are in sort order, then by ``id_column``; missing values last.
    """

    source: DataFrame
    id_column: str = "_id"
    clauses: dict[str, tuple[Column, ...]] = field(default_factory=dict)
    minimum: int | str | None = None
    order: tuple[tuple[str, bool], ...] = ()
    limit: int = 10
    skip: int = 0
    after: tuple[Any, ...] | None = None
    collapsed: str | None = None
    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    computed: tuple[tuple[str, str], ...] = ()
    near: dict[str, Any] | None = None

    def _with(self, name: str, clauses: Sequence[Column]) -> Search:
        return replace(self, clauses={**self.clauses, name: (*self.clauses.get(name, ()), *clauses)})

    def must(self, *clauses: Column) -> Search:
        return self._with("must", clauses)

    def should(self, *clauses: Column) -> Search:
        return self._with("should", clauses)

    def filter(self, *clauses: Column) -> Search:
        return self._with("filter", clauses)

    def must_not(self, *clauses: Column) -> Search:
        return self._with("must_not", clauses)

    def minimum_should_match(self, n: int | str) -> Search:
        return replace(self, minimum=n)

    def where(self, condition: str) -> Search:
        """A Spark SQL condition, in the place of a query-string grammar."""
        return self.filter(F.expr(condition))

    def visible_to(self, groups: Sequence[str], column: str = "visibleBy") -> Search:
        return replace(self, source=visible(self.source, groups, column))

    def sort(self, column: str, order: str = "asc") -> Search:
        return replace(self, order=(*self.order, (column, order == "desc")))

    def size(self, n: int) -> Search:
        return replace(self, limit=n)

    def from_(self, n: int) -> Search:
        return replace(self, skip=n)

    def search_after(self, *values: Any) -> Search:
        """Hits after the given sort values, the last one of ``id_column``."""
        return replace(self, after=values)

    def collapse(self, column: str) -> Search:
        return replace(self, collapsed=column)

    def include(self, *columns: str) -> Search:
        return replace(self, included=(*self.included, *columns))

    def exclude(self, *columns: str) -> Search:
        return replace(self, excluded=(*self.excluded, *columns))

    def script_field(self, name: str, expression: str) -> Search:
        return replace(self, computed=(*self.computed, (name, expression)))

    def knn(self, column: str, vector: Sequence[float], k: int, space: str = "l2", filter: Column | None = None, min_score: float | None = None, max_distance: float | None = None) -> Search:
        """The ``k`` nearest among the matches, which are filtered first."""
        chosen = self if filter is None else self.filter(filter)
        return replace(chosen, near={"column": column, "vector": list(vector), "k": k, "space": space, "min_score": min_score, "max_distance": max_distance}, limit=k)

    def matches(self) -> DataFrame:
        """All matching rows: what aggregations run on."""
        found = self.source.filter(bool_query(**self.clauses, minimum_should_match=self.minimum)) if self.clauses else self.source
        return vectors.nearest(found, self.id_column, **self.near) if self.near else found

    def total(self) -> int:
        return self.matches().count()

    def _keys(self) -> list[Column]:
        keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in self.order]
        return [*keys, F.col(self.id_column).asc_nulls_last()]

    def _after(self) -> Column:
        columns = [*self.order, (self.id_column, False)]
        if len(self.after) != len(columns):
            raise ValueError(f"search_after needs {len(columns)} values")
        found, equal = F.lit(False), F.lit(True)
        for (name, down), value in zip(columns, self.after):
            c = F.col(name)
            further = (c < F.lit(value)) if down else (c > F.lit(value))
            found = found | (equal & (further | c.isNull()))
            equal = equal & (c == F.lit(value))
        return F.coalesce(found, F.lit(False))

    def hits(self) -> DataFrame:
        """One page of matching rows."""
        found = self.matches()
        for name, expression in self.computed:
            found = found.withColumn(name, F.expr(expression))
        if self.collapsed:
            first = Window.partitionBy(self.collapsed).orderBy(*self._keys())
            found = found.withColumn("__first", F.row_number().over(first)).filter("__first = 1").drop("__first")
        if self.after is not None:
            found = found.filter(self._after())
        keys = [F.desc("_score"), F.col(self.id_column)] if self.near and not self.order else self._keys()
        found = found.orderBy(*keys)
        if self.skip:
            found = found.offset(self.skip)
        found = found.limit(self.limit)
        if self.included:
            found = found.select(*self.included)
        return found.drop(*self.excluded) if self.excluded else found
