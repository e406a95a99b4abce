"""Condition trees: comparisons and AND/OR nodes as Columns, and as a sound test of index entries.

SQL semantics: values are cast as Spark casts them, NULL never matches. may_hold(first, after) says whether the rows between two
neighbouring index entries may satisfy the tree: first is the first key of a block, after the first key of the next one (None:
unbounded). It may only be asked of the leading key column; any other column may always match.
"""

from __future__ import annotations

import datetime as dt
import enum
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Op(enum.Enum):
    """The six comparison operators."""

    EQUAL = "="
    NOT_EQUAL = "<>"
    GREATER = ">"
    GREATER_OR_EQUAL = ">="
    LESS = "<"
    LESS_OR_EQUAL = "<="


class Unbounded:
    """Stands for the key after the last entry of an index block."""


UNBOUNDED = Unbounded()


def _order(a: Any, b: Any) -> int | None:
    """-1, 0 or 1; None if the values can't be told apart soundly. A NULL key sorts first."""
    if a is None or b is None:
        return (a is not None) - (b is not None)
    if isinstance(a, dt.datetime) != isinstance(b, dt.datetime) and isinstance(a, dt.date) and isinstance(b, dt.date):
        a, b = (x if isinstance(x, dt.datetime) else dt.datetime(x.year, x.month, x.day) for x in (a, b))
    try:
        if a != a or b != b:
            return None
        return (a > b) - (a < b)
    except TypeError:
        return None


class Condition:
    """A node of a condition tree."""

    def column(self) -> Column:
        raise NotImplementedError

    def may_hold(self, key: str, first: Any, after: Any) -> bool:
        raise NotImplementedError

    def __and__(self, other: Condition) -> Condition:
        return And(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Or(self, other)


@dataclass(frozen=True)
class Compare(Condition):
    """column op value."""

    name: str
    op: Op
    value: Any

    def __post_init__(self) -> None:
        if not isinstance(self.op, Op):
            raise ValueError(f"unknown operator {self.op!r}")

    def column(self) -> Column:
        c, v = F.col(f"`{self.name}`"), F.lit(self.value)
        return {Op.EQUAL: c == v, Op.NOT_EQUAL: c != v, Op.GREATER: c > v, Op.GREATER_OR_EQUAL: c >= v, Op.LESS: c < v, Op.LESS_OR_EQUAL: c <= v}[self.op]

    def may_hold(self, key: str, first: Any, after: Any) -> bool:
        if self.name.lower() != key.lower():
            return True
        if self.value is None:
            return False
        value = self.value
        if not isinstance(value, (int, float, str, Decimal, dt.date)) or isinstance(value, str) != isinstance(first if first is not None else value, str):
            return True
        low = _order(first, value)
        high = 1 if after is UNBOUNDED else -1 if after is None else _order(after, value)
        if low is None or high is None:
            return True
        # A key equal to the next entry's may end this block too, so bounds are inclusive.
        return {
            Op.EQUAL: low <= 0 <= high, Op.NOT_EQUAL: not (low == 0 == high), Op.GREATER: high > 0, Op.GREATER_OR_EQUAL: high >= 0, Op.LESS: low < 0, Op.LESS_OR_EQUAL: low <= 0,
        }[self.op]


class _Nary(Condition):
    def __init__(self, *children: Condition | Iterable[Condition]) -> None:
        flat = [c for x in children for c in ([x] if isinstance(x, Condition) else x)]
        self.children = tuple(flat)

    def __repr__(self) -> str:
        return f"{type(self).__name__}{self.children!r}"


class And(_Nary):
    """All children hold; without children: true."""

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.children), F.lit(True))

    def may_hold(self, key: str, first: Any, after: Any) -> bool:
        return all(c.may_hold(key, first, after) for c in self.children)


class Or(_Nary):
    """Some child holds; without children: false."""

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (c.column() for c in self.children), F.lit(False))

    def may_hold(self, key: str, first: Any, after: Any) -> bool:
        return any(c.may_hold(key, first, after) for c in self.children)


def compare(name: str, op: Op | str, value: Any) -> Compare:
    """A comparison from an operator or its sign."""
    return Compare(name, op if isinstance(op, Op) else Op(op), value)
