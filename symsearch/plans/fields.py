"""Fields of a schema: how each column is searched.

A field turns a literal into a predicate on columns, at planning time.  A
predicate is a bare Catalyst expression where it can be, so that it reaches the
Parquet scan; rows with a null match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from symsearch.functions.terms import MAX_TERM_BYTES, basename, name_terms, normalise_path, normalise_path_literal, parse_integer, raw_terms, resolve_literal, words


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


@dataclass(frozen=True)
class ExactField:
    """Whole values, or their beginnings, with case."""

    name: str
    prefix: str = ""
    key: str | tuple[str, ...] = ""
    optional: bool = False

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.key,) if isinstance(self.key, str) and self.key else self.key or (self.name,)

    def too_long(self, value: str) -> bool:
        return len((self.prefix + value).encode()) > MAX_TERM_BYTES

    def check(self, value: str, wildcard: bool) -> None:
        """A ValueError if this field can't be asked for the value."""
        if wildcard and self.too_long(value):
            most = MAX_TERM_BYTES - len(self.prefix.encode())
            raise ValueError(f"Term for '{self.name}' field is too long, max size is {most}")

    def predicate(self, value: str, wildcard: bool, have: frozenset[str] = frozenset()) -> Column:
        if wildcard and not value:
            return any_of([self.present(c) for c in self.columns])
        return any_of([self.match(c, value, wildcard, have) for c in self.columns])

    def present(self, column: str) -> Column:
        return F.col(column).isNotNull()

    def match(self, column: str, value: str, wildcard: bool, have: frozenset[str]) -> Column:
        return F.col(column).startswith(value) if wildcard else F.col(column) == value

    def terms(self, column: str) -> Column | None:
        """The terms a value is listed under, as an array; None: it isn't listed."""
        return F.array(F.col(column).cast("string"))


@dataclass(frozen=True)
class TextField(ExactField):
    """Lower-case words of running text."""

    def match(self, column: str, value: str, wildcard: bool, have: frozenset[str]) -> Column:
        found = words(column)
        return F.exists(found, lambda t: t.startswith(value)) if wildcard else F.array_contains(found, value)

    def terms(self, column: str) -> Column:
        return words(column)


def terms_column(column: str) -> str:
    """Where an index keeps a name's terms, so that a search needn't make them."""
    return f"{column}__terms"


def path_columns(column: str) -> tuple[str, str]:
    """Where an index keeps a path as it is compared, and its last part."""
    return f"{column}__plain", f"{column}__base"


@dataclass(frozen=True)
class NameField(ExactField):
    """Names: the whole or one of its tokens, without case."""

    def match(self, column: str, value: str, wildcard: bool, have: frozenset[str]) -> Column:
        found = F.col(terms_column(column)) if terms_column(column) in have else name_terms(column)
        return self._match(found, value.lower(), wildcard)

    def _match(self, found: Column, value: str, wildcard: bool) -> Column:
        return F.exists(found, lambda t: t.startswith(value)) if wildcard else F.array_contains(found, value)

    def terms(self, column: str) -> Column:
        return raw_terms(column)


@dataclass(frozen=True)
class ReferencesField(NameField):
    """Arrays of names: any of them."""

    def present(self, column: str) -> Column:
        return F.size(column) > 0

    def match(self, column: str, value: str, wildcard: bool, have: frozenset[str]) -> Column:
        if terms_column(column) in have:
            return self._match(F.col(terms_column(column)), value.lower(), wildcard)
        return self._match(F.flatten(F.transform(column, name_terms)), value.lower(), wildcard)

    def terms(self, column: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(column, raw_terms)))


@dataclass(frozen=True)
class PathField(ExactField):
    """Paths: the whole or its last part; a relative literal also below the working directory."""

    base: str | None = None  #: in place of the working directory

    def literals(self, value: str) -> list[str]:
        plain = normalise_path_literal(value)
        return [plain] if plain.startswith("/") else [plain, resolve_literal(plain, self.base)]

    def match(self, column: str, value: str, wildcard: bool, have: frozenset[str]) -> Column:
        kept = path_columns(column)
        path = normalise_path(column)
        # bare columns reach the Parquet scan
        sides = [F.col(c) for c in kept] if have.issuperset(kept) else [path, basename(path)]
        return any_of([s.startswith(v) if wildcard else s == v for v in self.literals(value) for s in sides])

    def terms(self, column: str) -> Column:
        return F.array_distinct(F.array(normalise_path(column), basename(normalise_path(column))))


@dataclass(frozen=True)
class IntegerField(ExactField):
    """Whole numbers: one, or a range with or without its ends, decimal or hexadecimal."""

    unsigned: bool = False  #: the column's longs hold unsigned 64-bit numbers

    def too_long(self, value: str) -> bool:
        return False

    def bounds(self, value: str) -> tuple[int | None, int | None]:
        number = r"0[xX][0-9a-fA-F]+|[0-9]+"
        m = re.fullmatch(rf"({number})?(\.\.)?({number})?", value)
        if m is None or m[1] and m[3] and not m[2] or m[3] and not m[2]:
            raise ValueError(f"Invalid integer range value: {value}")
        if not m[1] and not m[3]:
            raise ValueError(f"Invalid integer range query: {value}")
        low, high = (parse_integer(x) if x else None for x in (m[1], m[3]))
        return (low, high) if m[2] else (low, low)

    def check(self, value: str, wildcard: bool) -> None:
        self.bounds(value)

    def predicate(self, value: str, wildcard: bool, have: frozenset[str] = frozenset()) -> Column:
        low, high = self.bounds(value)
        c = F.col(self.columns[0])
        if self.unsigned:
            return _unsigned_between(c, low or 0, (1 << 64) - 1 if high is None else high)
        if low == high:
            return c == _long(low)
        return c <= _long(high) if low is None else c >= _long(low) if high is None else (c >= _long(low)) & (c <= _long(high))

    def terms(self, column: str) -> None:
        return None


def _unsigned_between(c: Column, low: int, high: int) -> Column:
    """As comparisons of longs, so that they are pushed down: numbers from 2^63 on are the negative ones."""
    half, whole = 1 << 63, 1 << 64
    if low > high or low >= whole:
        return c.isNull() & c.isNotNull()
    high = min(high, whole - 1)
    parts = []
    if low < half:
        below = F.lit(min(high, half - 1))
        parts.append(c == below if low == high else (c >= F.lit(low)) & (c <= below))
    if high >= half:
        above, top = max(low, half) - whole, high - whole
        parts.append(c == F.lit(top) if above == top else (c >= F.lit(above)) & (c <= F.lit(top)))
    return any_of(parts)


def _long(n: int) -> Column:
    return F.lit(n) if n < 1 << 63 else F.lit(n).cast("decimal(20,0)") if n < 1 << 64 else F.lit(str(n)).cast("decimal(38,0)")


@dataclass(frozen=True)
class EnumField(ExactField):
    """One of a closed set of values."""

    values: tuple[str, ...] = ()

    def check(self, value: str, wildcard: bool) -> None:
        if wildcard and not any(v.startswith(value) for v in self.values):
            raise ValueError(f"Invalid prefix for '{self.name}' field: {value} (supported: {', '.join(self.values)})")
        if not wildcard and value not in self.values:
            raise ValueError(f"Invalid value for '{self.name}' field: {value} (supported: {', '.join(self.values)})")

    def match(self, column: str, value: str, wildcard: bool, have: frozenset[str]) -> Column:
        return F.col(column).isin(*(v for v in self.values if v.startswith(value))) if wildcard else F.col(column) == value


class SchemaError(ValueError):
    """Fields that can't be in one schema, or an index of another schema."""


@dataclass(frozen=True)
class Schema(Mapping):
    """Fields by name.  A schema of no fields takes every name as an exact field."""

    fields: tuple[ExactField, ...] = field(default=())

    def __post_init__(self) -> None:
        seen: dict[str, str] = {}
        for f in self.fields:
            if f.name in seen:
                raise SchemaError(f"Field {f.name} is in the schema twice")
            for other, prefix in seen.items():
                if f.prefix and prefix and (f.prefix.startswith(prefix) or prefix.startswith(f.prefix)):
                    raise SchemaError(f"Prefixes of {f.name} and {other} can't be told apart: {f.prefix}, {prefix}")
            seen[f.name] = f.prefix

    def __getitem__(self, name: str) -> ExactField:
        if not self.fields:
            return ExactField(name, f"X{name.upper()}")
        return {f.name: f for f in self.fields}[name]

    def __contains__(self, name: object) -> bool:
        return not self.fields or any(f.name == name for f in self.fields)

    def __iter__(self) -> Iterator[str]:
        return (f.name for f in self.fields)

    def __len__(self) -> int:
        return len(self.fields)

    def described(self) -> list[list]:
        """A form that can be stored and compared."""
        return [[type(f).__name__, f.name, f.prefix, list(f.columns), f.optional, list(getattr(f, "values", ()))] for f in self.fields]
