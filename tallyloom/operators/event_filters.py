"""Filters of contract events: types, contracts and topic patterns, as one predicate that Spark can push down in part."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

ANY, REST = "*", "**"
MAX_FILTERS, MAX_CONTRACTS, MAX_PATTERNS, MAX_SEGMENTS = 5, 5, 5, 4


@dataclass(frozen=True)
class EventFilter:
    """Events of one of ``types`` from one of ``contracts`` whose topics fit one of ``topics``; an empty list allows all."""

    types: tuple[str, ...] = ()
    contracts: tuple = ()
    topics: tuple[tuple, ...] = field(default=())

    def check(self) -> None:
        if len(self.contracts) > MAX_CONTRACTS or len(self.topics) > MAX_PATTERNS:
            raise ValueError("too many contracts or patterns in a filter")
        for pattern in self.topics:
            body = pattern[:-1] if pattern and pattern[-1] == REST else pattern
            if not pattern or REST in body or len(body) > MAX_SEGMENTS:
                raise ValueError("a pattern has 1 to 4 segments and ** only at its end")


def fits_pattern(topics: Column, pattern: tuple) -> Column:
    """Is ``topics`` as long as the pattern and equal where it is not ``*``? A last ``**`` stands for any number more."""
    body = pattern[:-1] if pattern[-1] == REST else pattern
    size = F.size(topics) >= len(body) if pattern[-1] == REST else F.size(topics) == len(body)
    return reduce(lambda a, b: a & b, [F.coalesce(F.get(topics, F.lit(i)) == F.lit(x), F.lit(False)) for i, x in enumerate(body) if x != ANY], F.coalesce(size, F.lit(False)))


def fits_positions(topics: Column, positions: tuple) -> Column:
    """Is ``topics`` equal wherever ``positions`` is not None?"""
    return reduce(lambda a, b: a & b, [F.coalesce(F.get(topics, F.lit(i)) == F.lit(x), F.lit(False)) for i, x in enumerate(positions) if x is not None], F.lit(True))


def fits(filters: list[EventFilter], *, kind: Column, contract: Column, topics: Column) -> Column:
    """Any of the filters; no filters: every event. A null contract is in no list."""
    if len(filters) > MAX_FILTERS:
        raise ValueError("too many filters")
    found = []
    for f in filters:
        f.check()
        one = F.lit(True)
        if f.types:
            one &= kind.isin(*f.types)
        if f.contracts:
            one &= F.coalesce(contract.isin(*f.contracts), F.lit(False))
        if f.topics:
            one &= reduce(lambda a, b: a | b, [fits_pattern(topics, p) for p in f.topics])
        found.append(one)
    return reduce(lambda a, b: a | b, found) if found else F.lit(True)


def check_request(*, filters: list[EventFilter], limit: int, max_limit: int, first: int | None = None, last: int | None = None, after: str | None = None, max_filters: int = MAX_FILTERS, ascending_needs_first: bool = False) -> None:
    """A request names a range or a cursor, not both; at most ``max_filters`` filters of good form; a limit in 1..max_limit."""
    if after is not None and (first is not None or last is not None):
        raise ValueError("a range and a cursor exclude each other")
    if after is None and first is None and (ascending_needs_first or last is None):
        raise ValueError("a first ledger is needed")
    if first is not None and last is not None and first > last:
        raise ValueError("the range is empty")
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be in 1..{max_limit}")
    if len(filters) > max_filters:
        raise ValueError("too many filters")
    for f in filters:
        f.check()


#: The most rows that a query may ask for, whatever a provider allows. Fixed value.
MAX_LIMIT = 1000


def query_fault(*, cursor: Column, first: Column, last: Column, order: Column, n_filters: Column, limit: Column, max_limit: int = MAX_LIMIT, max_filters: int = 256) -> Column:
    """Why a query for events is refused, null where it is not: one column for logs of many queries.

    A query with a cursor names nothing else but a limit. 0, '' and null say that a ledger, an order or a cursor is not
    named; ``n_filters`` is null without a list of filters and 0 for an empty one, which is refused.
    """
    low, high = F.coalesce(first, F.lit(0)), F.coalesce(last, F.lit(0))
    way = F.coalesce(order, F.lit(""))
    resumed = F.coalesce(cursor, F.lit("")) != ""
    more = (low != 0) | (high != 0) | (way != "") | n_filters.isNotNull()
    found = F.when(limit.isNotNull() & ~limit.between(1, min(max_limit, MAX_LIMIT)), "limit").when(resumed, F.when(more, "cursor and range"))
    found = found.when(~way.isin("", "asc", "desc"), "order").when((way != "desc") & (low == 0), "no first ledger")
    return found.when((low != 0) & (high != 0) & (low > high), "empty range").when(n_filters.isNotNull() & ~n_filters.between(1, max_filters), "filters")
