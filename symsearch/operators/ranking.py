"""Relevance: BM25 over a query's leaves.

Each leaf is one term; a prefix is as if all terms that begin so were one.  How
many rows each leaf matches and how long rows are on average is found in one
aggregation; the score then is column arithmetic.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symsearch.functions.terms import unsigned_order
from symsearch.operators.checkpoints import checkpointed
from symsearch.plans.ast import Leaf, leaves
from symsearch.plans.compiler import predicate
from symsearch.plans.fields import IntegerField, NameField, Schema
from symsearch.plans.parser import Parser

# The usual parameters, and the weight of a match that needed lower case.
K1, B, LEAST_LENGTH, FOLDED = 1.0, 0.5, 0.5, 0.6667


def _frequency(leaf: Leaf, schema: Schema) -> Column:
    """How often a leaf's term stands among a row's terms, null if the field has none."""
    field = schema[leaf.field]
    parts = []
    for c in field.columns:
        terms = field.terms(c)
        if terms is None:
            return F.lit(0)
        value = leaf.value.lower() if isinstance(field, NameField) else leaf.value
        test = (lambda t: t.startswith(value)) if leaf.wildcard else (lambda t: t == value)
        parts.append(F.coalesce(F.size(F.filter(terms, test)), F.lit(0)))
    return sum(parts[1:], parts[0])


def _length(schema: Schema) -> Column:
    """The number of a row's terms."""
    parts = [F.coalesce(F.size(F.filter(t, lambda x: x.isNotNull())), F.lit(0)) for f in schema.values() for c in f.columns if (t := f.terms(c)) is not None and len(f.columns) == 1]
    return sum(parts[1:], parts[0]) if parts else F.lit(1)


def scored(df: DataFrame, query: str, parser: Parser) -> DataFrame:
    """The rows that a query matches, with their ``score``."""
    schema, node = parser.schema, parser.parse(query)
    asked = [x for x in dict.fromkeys(leaves(node)) if not isinstance(schema[x.field], IntegerField)]
    have = frozenset(df.columns)
    matched = df.where(predicate(node, schema, have))
    if not asked:
        return matched.withColumn("score", F.lit(0.0))
    tests = [F.coalesce(predicate(x, schema, have), F.lit(False)) for x in asked]
    row = df.agg(F.count(F.lit(1)), F.avg(_length(schema)), *(F.count_if(t) for t in tests)).first()
    n, mean = row[0], row[1] or 1.0
    norm = F.greatest(F.lit(LEAST_LENGTH), _length(schema) / F.lit(mean))
    total = F.lit(0.0)
    for leaf, test, found in zip(asked, tests, row[2:], strict=True):
        weight = math.log((n - found + 0.5) / (found + 0.5)) if found < n else -1.0
        weight = weight if weight >= 2 else max(weight, 0.0) * 0.5 + 1
        f = F.greatest(_frequency(leaf, schema), F.lit(1))
        folded = FOLDED if isinstance(schema[leaf.field], NameField) and leaf.value != leaf.value.lower() else 1.0
        total = total + F.when(test, F.lit(weight * folded * (K1 + 1)) * f / (F.lit(K1) * (norm * B + (1 - B)) + f)).otherwise(0.0)
    return matched.withColumn("score", total)


def ranked(df: DataFrame, query: str, parser: Parser, ties: tuple[str, ...] = ("path", "address", "name"), first: int = 0, limit: int | None = None) -> DataFrame:
    """Matching rows by falling score: with a limit, one top-k."""
    rows = scored(df, query, parser).orderBy(F.desc("score"), *(unsigned_order(t) if t == "address" else t for t in ties if t in df.columns))
    rows = rows.offset(first) if first else rows
    return rows if limit is None else rows.limit(limit)


def with_ordinals(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` in order, with ``index`` from 0 and ``total``.

    The rows are sorted over all tasks; a number for each partition, how many
    rows come before it, makes places in partitions places in the whole.
    """
    placed = checkpointed(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part).agg(F.count(F.lit(1))).collect())
    begins = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False))
    begin = F.lit(0).cast("long")
    if begins:
        begin = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in begins.items() for x in pair)), part)
    return placed.withColumn("index", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + begin).withColumn("total", F.lit(sum(n for _, n in counts)).cast("long")).drop("__at")
