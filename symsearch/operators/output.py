"""Hits as dicts, JSON lines, S-expressions and formatted text, as column expressions."""

from __future__ import annotations

import re
import string
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symsearch.functions.terms import basename, end_address, unsigned

#: The order of a hit's keys.
KEYS = ("outdated", "index", "total", "arch", "path", "source", "name", "demangled", "section", "address", "size", "type", "relocations", "mtime")


def with_dynamic_fields(rows: DataFrame) -> DataFrame:
    return rows.withColumn("basename", basename("path")).withColumn("endaddress", end_address())


def _shown(rows: DataFrame) -> DataFrame:
    """Addresses as unsigned numbers."""
    return rows.withColumns({c: unsigned(c) for c in ("address", "endaddress") if c in rows.columns})


def as_json(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``json``: one line a row; nulls are written."""
    rows = _shown(rows)
    return rows.select(F.to_json(F.struct(*(k for k in keys if k in rows.columns)), {"ignoreNullFields": "false"}).alias("json"))


def sexp(c: Column, kind: T.DataType) -> Column:
    """A value as Lisp reads it: null and false are nil, true t, a list its items, a struct a plist."""
    if isinstance(kind, T.BooleanType):
        text = F.when(c, F.lit("t")).otherwise(F.lit("nil"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("("), F.array_join(F.transform(c, lambda x: sexp(x, kind.elementType)), " "), F.lit(")"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f":{f.name} "), sexp(c[f.name], f.dataType)) for f in kind]
        text = F.concat(F.lit("("), F.concat_ws(" ", *parts), F.lit(")"))
    elif isinstance(kind, T.StringType):
        # as JSON writes it: the text of a struct of one field without its frame
        text = F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    else:
        text = c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), text), F.lit("nil"))


def as_sexp(rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    rows = _shown(rows)
    chosen = T.StructType([rows.schema[k] for k in keys if k in rows.columns])
    return rows.select(sexp(F.struct(*chosen.fieldNames()), chosen).alias("sexp"))


_SPEC = re.compile(r"(?:(?P<fill>[^{}])?(?P<align>[<>]))?(?P<zero>0)?(?P<width>[0-9]+)?(?P<kind>[xXds])?")


def _formatted(c: Column, kind: T.DataType, spec: str) -> Column | None:
    """A Python format spec over a column with built-in functions; None: it isn't that simple."""
    m = _SPEC.fullmatch(spec)
    wide = isinstance(kind, T.DecimalType)  # an unsigned number
    number = wide or isinstance(kind, T.LongType | T.IntegerType)
    if m is None or m["kind"] in ("x", "X", "d") and not number or m["kind"] == "s" and number:
        return None
    digits = F.conv(c.cast("string"), 10, 16) if wide else F.hex(c)
    text = F.lower(digits) if m["kind"] == "x" else digits if m["kind"] == "X" else c.cast("string")
    if m["width"]:
        fill = m["fill"] or ("0" if m["zero"] else " ")
        right = m["align"] == ">" or not m["align"] and number
        width = F.lit(int(m["width"]))
        padded = F.lpad(text, width, fill) if right else F.rpad(text, width, fill)
        text = F.when(F.char_length(text) < width, padded).otherwise(text)
    return text


def as_text(rows: DataFrame, template: str = "{basename}: {name}") -> DataFrame:
    """``text``: a Python format template filled in for each row.

    Simple specs become built-in functions; others are formatted in Arrow
    batches.  An unknown key is an error that names the known ones.
    """
    rows = _shown(with_dynamic_fields(rows))
    parts: list[Column] = []
    parsed = list(string.Formatter().parse(template))
    for literal, key, spec, convert in parsed:
        if literal:
            parts.append(F.lit(literal))
        if key is None:
            continue
        if key not in rows.columns:
            raise ValueError(f"Unknown key {key!r} in format, known keys: {', '.join(rows.columns)}")
        text = None if convert else _formatted(F.col(key), rows.schema[key].dataType, spec or "")
        if text is None:
            return rows.select(_format_udf(template, [k for _, k, _, _ in parsed if k])(F.struct(*{k: 0 for _, k, _, _ in parsed if k})).alias("text"))
        parts.append(F.coalesce(text, F.lit("None")))
    return rows.select(F.concat(*parts).alias("text") if parts else F.lit("").alias("text"))


def _format_udf(template: str, keys: list[str]):
    @F.pandas_udf(T.StringType())
    def fill(batch: pd.DataFrame) -> pd.Series:
        whole = lambda row: {k: int(v) if isinstance(v, Decimal) else v for k, v in row.items()}
        return pd.Series([template.format(**whole(row)) for row in batch.to_dict("records")], index=batch.index, dtype=object)

    return fill
