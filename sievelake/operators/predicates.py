"""Search predicates as columns.

Each takes a column (or its name) and literals.  An array column matches if any
of its elements does.  A missing value matches nothing; under :func:`none_of`,
and where clauses are counted, it therefore counts as no match.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import net, text


def col(field: str | Column) -> Column:
    return field if isinstance(field, Column) else F.col(field)


def term(field, value: Any) -> Column:
    return col(field) == F.lit(value)


def terms(field, values: Sequence[Any]) -> Column:
    return col(field).isin(*values)


def term_any(field, value: Any) -> Column:
    """A term over an array column."""
    return F.array_contains(col(field), value)


def terms_any(field, values: Sequence[Any]) -> Column:
    """Any of several terms over an array column."""
    return F.arrays_overlap(col(field), F.array(*[F.lit(v) for v in values])) if values else F.lit(False)


def between(field, gte: Any = None, lte: Any = None, gt: Any = None, lt: Any = None) -> Column:
    """A range; bounds left out are open."""
    c = col(field)
    parts = [p for p in (None if gte is None else c >= F.lit(gte), None if lte is None else c <= F.lit(lte), None if gt is None else c > F.lit(gt), None if lt is None else c < F.lit(lt)) if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else c.isNotNull()


_OPERATORS = {"gte": "gte", "lte": "lte", "gt": "gt", "lt": "lt"}


def range_(field, operator: str, value: Any) -> Column:
    if operator not in _OPERATORS:
        raise ValueError(f"no such range operator: {operator}")
    return between(field, **{operator: value})


def exists(field) -> Column:
    return col(field).isNotNull()


def prefix(field, value: str) -> Column:
    return col(field).startswith(value)


def wildcard(field, pattern: str) -> Column:
    return text.wildcard(col(field), pattern)


def regexp(field, pattern: str) -> Column:
    return text.regexp(col(field), pattern)


def ids(values: Sequence[Any], field="_id") -> Column:
    return col(field).isin(*values)


def match(field, query: str, operator: str = "or", minimum: int | None = None) -> Column:
    return text.match(col(field), query, operator, minimum)


def match_phrase(field, query: str) -> Column:
    return text.match_phrase(col(field), query)


def match_phrase_prefix(field, query: str) -> Column:
    return text.match_phrase_prefix(col(field), query)


def match_bool_prefix(field, query: str) -> Column:
    return text.match_bool_prefix(col(field), query)


def fuzzy(field, value: str, fuzziness: str = "AUTO") -> Column:
    return text.fuzzy(col(field), value, fuzziness)


def multi_match(query: str, fields: Sequence[str], kind: str = "best_fields") -> Column:
    """A match over several fields; ``cross_fields`` wants every token in some field."""
    if kind == "cross_fields":
        return all_of(*[any_of(*[match(f, t) for f in fields]) for t in dict.fromkeys(text.analyse(query))])
    if kind in ("phrase", "phrase_prefix"):
        one = match_phrase if kind == "phrase" else match_phrase_prefix
        return any_of(*[one(f, query) for f in fields])
    return any_of(*[match(f, query) for f in fields])


def cidr(field, network: str) -> Column:
    return net.in_networks(col(field), [network])


def cidrs(field, networks: Sequence[str]) -> Column:
    return net.in_networks(col(field), list(networks))


def ip_range_contains(low, high, address: str) -> Column:
    """Stored ranges that hold an address."""
    k = net.key_of(address)
    return (net.ip_key(col(low)) <= k) & (net.ip_key(col(high)) >= k)


def ip_range_intersects(low, high, first: str, last: str) -> Column:
    return (net.ip_key(col(low)) <= net.key_of(last)) & (net.ip_key(col(high)) >= net.key_of(first))


def ip_range_within(low, high, first: str, last: str) -> Column:
    return (net.ip_key(col(low)) >= net.key_of(first)) & (net.ip_key(col(high)) <= net.key_of(last))


def match_all() -> Column:
    return F.lit(True)


def _sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def all_of(*clauses: Column) -> Column:
    return reduce(lambda a, b: a & b, clauses) if clauses else F.lit(True)


def any_of(*clauses: Column) -> Column:
    return reduce(lambda a, b: a | b, clauses) if clauses else F.lit(False)


def none_of(*clauses: Column) -> Column:
    """True where no clause matches, missing values included."""
    return all_of(*[~_sure(c) for c in clauses])


def at_least(n: int | str, *clauses: Column) -> Column:
    """At least ``n`` clauses match; negative: that many may fail; ``"p%"``: a share."""
    if isinstance(n, str) and n.endswith("%"):
        share = int(n[:-1])
        n = len(clauses) * share // 100 if share >= 0 else len(clauses) + -(-len(clauses) * share // 100)
    n = int(n)
    if n < 0:
        n += len(clauses)
    if n <= 0:
        return F.lit(True)
    return reduce(lambda a, b: a + b, [_sure(c).cast("int") for c in clauses], F.lit(0)) >= n


def bool_query(must: Sequence[Column] = (), should: Sequence[Column] = (), filter: Sequence[Column] = (), must_not: Sequence[Column] = (), minimum_should_match: int | str | None = None) -> Column:
    """All of ``must`` and ``filter``, none of ``must_not``, enough of ``should``.

    Without a minimum, one ``should`` is needed if there is nothing to match else.
    """
    parts = [*must, *filter]
    if should:
        if minimum_should_match is None:
            minimum_should_match = 0 if parts else 1
        if minimum_should_match == 1:
            parts.append(any_of(*should))
        elif minimum_should_match != 0:
            parts.append(at_least(minimum_should_match, *should))
    if must_not:
        parts.append(none_of(*must_not))
    return all_of(*parts)
