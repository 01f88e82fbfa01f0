"""What a query means, before it is turned into a plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class All:
    """Every row."""


@dataclass(frozen=True)
class Nothing:
    """No row."""


@dataclass(frozen=True)
class Leaf:
    field: str
    value: str
    wildcard: bool = False


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class And:
    of: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    of: tuple[Node, ...]


Node = All | Nothing | Leaf | Not | And | Or


def joined(kind: type[And] | type[Or], parts: list[Node]) -> Node:
    """One node of parts, with parts of its own kind taken apart."""
    flat = [x for p in parts for x in (p.of if isinstance(p, kind) else (p,))]
    return flat[0] if len(flat) == 1 else kind(tuple(flat))


def leaves(node: Node) -> list[Leaf]:
    """The leaves that add to a row's relevance: those under no NOT."""
    if isinstance(node, Leaf):
        return [node]
    return [x for n in node.of for x in leaves(n)] if isinstance(node, And | Or) else []
