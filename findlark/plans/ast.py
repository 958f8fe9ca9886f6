"""Query objects."""

from __future__ import annotations

from dataclasses import dataclass, replace

DEFAULT_FIELD = "_default"
MUST, SHOULD, NOT = "must", "should", "not"


@dataclass(frozen=True)
class Term:
    text: str
    field: str = ""


@dataclass(frozen=True)
class Phrase:
    """near: None for neighbours in order; otherwise up to so many tokens may stand between."""

    text: str
    field: str = ""
    near: int | None = None

    def __post_init__(self):
        if self.near is not None and self.near < 0:
            raise QueryError("a distance cannot be negative")


@dataclass(frozen=True)
class Prefix:
    text: str
    field: str = ""


@dataclass(frozen=True)
class Clause:
    occur: str
    query: "Query | None"


@dataclass(frozen=True)
class Boolean:
    clauses: tuple[Clause, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "clauses", tuple(self.clauses))


Query = Term | Phrase | Prefix | Boolean


class QueryError(ValueError):
    """A query that cannot be read or run."""


def must(q: Query | None) -> Clause:
    return Clause(MUST, q)


def should(q: Query | None) -> Clause:
    return Clause(SHOULD, q)


def must_not(q: Query | None) -> Clause:
    return Clause(NOT, q)


@dataclass(frozen=True)
class FieldClause:
    """A query string bound to one field."""

    occur: str
    field: str
    text: str


def bind(q: Query | None, field: str) -> Query | None:
    """q with field wherever it names none."""
    if isinstance(q, Boolean):
        return Boolean(tuple(Clause(c.occur, bind(c.query, field)) for c in q.clauses))
    if q is None or q.field:
        return q
    return replace(q, field=field)
