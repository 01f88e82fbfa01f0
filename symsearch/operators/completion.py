"""Completion of half-written queries."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symsearch.plans.fields import PathField
from symsearch.plans.lexer import QueryError, Token, token_at
from symsearch.plans.parser import Parser


def terms(df: DataFrame, parser: Parser, field: str, prefix: str = "", limit: int | None = None) -> DataFrame:
    """``term``: the distinct terms of a field that begin so, in order; an integer field has none."""
    f = parser.schema[field]
    found = [f.terms(c) for c in f.columns]
    if any(t is None for t in found):
        return df.sparkSession.createDataFrame([], "term string")
    begins = lambda t: t.isNotNull() & t.startswith(prefix)
    listed = F.filter(F.flatten(F.array(*(F.coalesce(t, F.array().cast("array<string>")) for t in found))), begins)
    out = df.select(F.explode(listed).alias("term")).distinct().orderBy("term")
    return out if limit is None else out.limit(limit)


def _lexed(query: str) -> tuple[list[Token], bool]:
    """All tokens, spaces too; an unterminated string is a string to the end (True)."""
    out, at = [], 0
    while at < len(query):
        try:
            token = token_at(query, at)
        except QueryError:
            start = query.index('"', at)
            return [*out, Token("string", query[start + 1 :], start + 1, len(query))], True
        if token.kind == "end":
            break
        out.append(token)
        at = token.stop
    return out, False


def _plain(text: str) -> bool:
    """Whether a text can stand in a query as it is, as one token with or without a wildcard."""
    try:
        stop = token_at(text, 0).stop if text else 0
    except QueryError:
        return False
    return stop == len(text) or stop == len(text) - 1 and text[-1] == "*"


def _paths(df: DataFrame, parser: Parser, field: str, text: str) -> Iterator[str]:
    """Files and folders that begin so and lead to something in the index."""
    if text.startswith("/"):
        return
    for found in sorted(glob.glob(glob.escape(text) + "*")):
        if terms(df, parser, field, os.path.realpath(found), limit=1).isEmpty():
            continue
        shown = os.path.normpath(found)
        shown = "./" + shown if text.startswith("./") else shown
        yield from (shown + "/", shown + "/*") if os.path.isdir(found) else (shown,)


def complete(df: DataFrame, query: str, parser: Parser, limit: int | None = None) -> list[str]:
    """Whole queries that the given one may become: keywords, fields, values of the field or of the default fields."""
    out = dict.fromkeys(_complete(df, query, parser, limit))
    return list(out)


def _complete(df: DataFrame, query: str, parser: Parser, limit: int | None) -> Iterator[str]:
    schema = parser.schema
    read, open_string = _lexed(query)
    last = read[-1] if read else None
    before = read[-2] if len(read) > 1 else None
    kept = query[: last.start] if last else ""
    kind, value = (last.kind, last.value) if last else (None, "")
    if kind == "field":
        before, kind, value, kept = last, "term", "", query

    def shown(text: str, front: str = kept) -> str:
        return front + (text + '"' if open_string and front == kept and front else text if _plain(text) else json.dumps(text))

    in_field = before is not None and before.kind == "field"
    if kind in ("term", "space", None) and not in_field:
        gap, tail = " " if kind == "space" else "", " " if kept else ""
        if before is None or before.kind not in ("and", "or", "not"):
            for word in ("AND", "OR", "NOT"):
                if word.startswith(value.strip() if kind == "space" else value):
                    yield f"{kept}{gap}{word}{tail}"
        for name in schema:
            if (gap + name + ":").startswith(value):
                yield f"{kept}{gap}{name}:"
    fields = [before.value] if in_field else [*parser.defaults]
    if kind in ("term", "string", None):
        for name in fields:
            if name not in schema:
                continue
            for row in terms(df, parser, name, value, limit).toLocalIterator():
                yield shown(row.term)
            if isinstance(schema[name], PathField):
                for path in _paths(df, parser, name, value):
                    yield shown(path)
    for name in parser.defaults:
        for row in terms(df, parser, name, query, limit).toLocalIterator():
            yield row.term if _plain(row.term) else json.dumps(row.term)
