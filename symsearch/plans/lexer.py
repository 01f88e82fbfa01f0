"""Tokens of the search language."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass


class QueryError(ValueError):
    """The query cannot be understood; the message says where."""


@dataclass(frozen=True)
class Token:
    kind: str  #: space, and, or, not, (, ), string, field, all, wildcard, term, end
    value: str
    start: int
    stop: int


# In this order; a string is read by the JSON decoder where a quote stands.
_KINDS = (
    ("space", r"\s+"),
    ("and", r"AND\b"),
    ("or", r"OR\b"),
    ("not", r"NOT\b|!"),
    ("(", r"\("),
    (")", r"\)"),
    ("field", r"[a-zA-Z_]+:"),
    ("all", r"\*:\*"),
    ("wildcard", r"\*"),
    ("term", r"[^\s()*]+"),
)
_TOKEN = re.compile("|".join(f"(?P<k{i}>{p})" for i, (_, p) in enumerate(_KINDS)))
_JSON = json.JSONDecoder()


def token_at(query: str, at: int) -> Token:
    """The token that begins at a position; what begins none is skipped."""
    while at < len(query):
        if query[at] == '"':
            try:
                value, stop = _JSON.raw_decode(query, at)
            except ValueError as e:
                raise QueryError(f"Unterminated string at position {at}") from e
            return Token("string", value, at, stop)
        if m := _TOKEN.match(query, at):
            kind = _KINDS[int(m.lastgroup[1:])][0]
            return Token(kind, m[0][:-1] if kind == "field" else m[0], at, m.end())
        at += 1
    return Token("end", "", len(query), len(query))


def tokens(query: str, spaces: bool = False) -> list[Token]:
    """All tokens of a query, the end last."""
    out = [token_at(query, 0)]
    while out[-1].kind != "end":
        out.append(token_at(query, out[-1].stop))
    return [t for t in out if spaces or t.kind != "space"]
