"""A second way to run a query: over a table of postings.

The scan of a terms column reads all rows.  Postings, (field, term, rid) sorted
by field and term, let a leaf read only the row groups in which its term or
prefix can be: the filter is pushed down and Parquet's statistics skip the rest.
AND becomes a semi-join of row ids, OR a union, NOT an anti-join; leaves on
other fields stay predicates on the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symsearch.functions.terms import name_terms
from symsearch.plans.ast import All, And, Leaf, Node, Not, Nothing
from symsearch.plans.compiler import predicate
from symsearch.plans.fields import NameField, ReferencesField, Schema

RID = "__rid"


def listed(schema: Schema, leaf: Leaf) -> bool:
    """Whether postings answer a leaf."""
    return isinstance(schema[leaf.field], NameField) and bool(leaf.value)


def _any_listed(node: Node, schema: Schema) -> bool:
    if isinstance(node, Leaf):
        return listed(schema, node)
    if isinstance(node, All | Nothing):
        return False
    return any(_any_listed(n, schema) for n in (node.of if isinstance(node.of, tuple) else (node.of,)))


def postings(rows: DataFrame, schema: Schema, rid: str = RID) -> DataFrame:
    """(field, term, rid) of the schema's name fields, each term of a row once, in ranges of field and term."""
    parts = []
    for f in schema.values():
        if isinstance(f, NameField):
            (column,) = f.columns
            found = F.array_distinct(F.flatten(F.transform(column, name_terms))) if isinstance(f, ReferencesField) else name_terms(column)
            parts.append(rows.select(F.lit(f.name).alias("field"), F.explode(found).alias("term"), F.col(rid).alias("rid")))
    whole = reduce(DataFrame.union, parts)
    return whole.repartitionByRange("field", "term").sortWithinPartitions("field", "term")


def matching_ids(node: Node, rows: DataFrame, table: DataFrame, schema: Schema, rid: str = RID) -> DataFrame:
    """``rid`` of the rows that a query matches, each once if rows have ids of their own."""
    all_ids = rows.select(F.col(rid).alias("rid"))
    if not _any_listed(node, schema):
        return rows.where(predicate(node, schema, rows.columns)).select(F.col(rid).alias("rid"))
    if isinstance(node, Leaf):
        value, term = node.value.lower(), F.col("term")
        return table.where((F.col("field") == node.field) & (term.startswith(value) if node.wildcard else term == value)).select("rid").distinct()
    if isinstance(node, Not):
        return all_ids.join(matching_ids(node.of, rows, table, schema, rid), "rid", "left_anti")
    if isinstance(node, And):
        plain = [n for n in node.of if not _any_listed(n, schema)]
        some = [n for n in node.of if _any_listed(n, schema)]
        asked = [n for n in some if not isinstance(n, Not)]
        start = rows.where(predicate(And(tuple(plain)), schema, rows.columns)).select(F.col(rid).alias("rid")) if plain else None
        if start is None:
            start = matching_ids(asked.pop(0), rows, table, schema, rid) if asked else all_ids
        for n in asked:
            start = start.join(matching_ids(n, rows, table, schema, rid), "rid", "left_semi")
        for n in some:
            if isinstance(n, Not):
                start = start.join(matching_ids(n.of, rows, table, schema, rid), "rid", "left_anti")
        return start
    return reduce(DataFrame.union, [matching_ids(n, rows, table, schema, rid) for n in node.of]).distinct()


def search(node: Node, rows: DataFrame, table: DataFrame, schema: Schema, rid: str = RID) -> DataFrame:
    """The rows that a query matches."""
    if not _any_listed(node, schema):
        return rows.where(predicate(node, schema, rows.columns))
    return rows.join(matching_ids(node, rows, table, schema, rid).withColumnRenamed("rid", rid), rid, "left_semi").select(*rows.columns)
