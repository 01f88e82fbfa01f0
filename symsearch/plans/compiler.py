"""From a query's meaning to a Catalyst predicate.

Leaves are bare expressions, so that they are pushed down.  A leaf over a null
is null, which a filter takes for false, and AND and OR never make true of it;
only what stands under a NOT has to be made two-valued first.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symsearch.plans.ast import All, And, Leaf, Node, Not, Nothing
from symsearch.plans.fields import Schema
from symsearch.plans.parser import Parser


def predicate(node: Node, schema: Schema, have: Iterable[str] = ()) -> Column:
    """``have``: the columns there are (an index's extra columns are used if they are)."""
    have = frozenset(have)
    if isinstance(node, All):
        return F.lit(True)
    if isinstance(node, Nothing):
        return F.lit(False)
    if isinstance(node, Leaf):
        return schema[node.field].predicate(node.value, node.wildcard, have)
    if isinstance(node, Not):
        return ~F.coalesce(predicate(node.of, schema, have), F.lit(False))
    parts = [predicate(n, schema, have) for n in node.of]
    return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), parts)


def search(df: DataFrame, query: str, parser: Parser) -> DataFrame:
    """The rows of ``df`` that a query matches."""
    return df.where(predicate(parser.parse(query), parser.schema, df.columns))
