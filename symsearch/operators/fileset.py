"""What has changed between an index and the files there are: joins of file sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def max_mtime(rows: DataFrame) -> int:
    """The newest file of an index, 0 if it is empty: an aggregate that Parquet's statistics can answer."""
    return rows.agg(F.coalesce(F.max("mtime"), F.lit(0))).first()[0]


def changed_files(current: DataFrame, previous: DataFrame, newest: int | Column) -> DataFrame:
    """Files of ``current`` (path, mtime) that ``previous`` (path) lacks, or that are newer than all of the index."""
    newest = F.lit(newest) if isinstance(newest, int) else newest
    known = previous.select("path").distinct().withColumn("known", F.lit(True))
    return current.join(known, "path", "left").where(F.col("known").isNull() | (F.col("mtime") > newest)).drop("known")


def deleted_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files of ``previous`` that ``current`` lacks."""
    return previous.select("path").distinct().join(current.select("path"), "path", "left_anti")


def stale_rows(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the given files."""
    return rows.join(files.select("path").distinct(), "path", "left_semi")


def upsert(rows: DataFrame, fresh: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """``rows`` without those of changed and deleted files, and with ``fresh`` ones."""
    gone = changed.select("path").union(deleted.select("path")).distinct()
    return rows.join(gone, "path", "left_anti").select(*fresh.columns).unionByName(fresh)


def distinct_files(rows: DataFrame) -> DataFrame:
    return rows.select("path").distinct()


def totals(rows: DataFrame) -> DataFrame:
    """(files, symbols): how many files have symbols, and how many symbols there are; the row of a file without any isn't one."""
    named = rows.where(F.col("name") != "")
    return named.agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("symbols"))


def plan(changed: DataFrame, deleted: DataFrame, known: DataFrame) -> DataFrame:
    """(action, path) of what an index run would do."""
    outdated = changed.join(known.select("path").distinct(), "path", "left_semi")
    return (
        deleted.select(F.lit("unindex-deleted-file").alias("action"), "path")
        .union(outdated.select(F.lit("unindex-outdated-file"), "path"))
        .union(changed.select(F.lit("index"), "path"))
    )


def with_staleness(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``rows`` with ``outdated`` (binary, symbol); ``stats``: (path, mtime) of the files there are.

    A symbol is outdated if its file's time isn't the indexed one (a missing file
    has time 0); a binary is, if its source is known and newer.
    """
    taken = {c.lower() for c in rows.columns}
    a, b = (next(n for n in ("_" * k + x for k in range(1, 99)) if n not in taken) for x in ("own", "of_source"))
    own = stats.select(F.col("path").alias("path"), F.col("mtime").alias(a))
    of_source = stats.select(F.col("path").alias("source"), F.col("mtime").alias(b))
    own_time, source_time = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    flags = F.struct((F.col("source").isNotNull() & (own_time < source_time)).alias("binary"), (own_time != F.col("mtime")).alias("symbol"))
    return rows.join(own, "path", "left").join(of_source, "source", "left").withColumn("outdated", flags).drop(a, b)


def stale_counts(rows: DataFrame) -> DataFrame:
    """(symbol_files, binary_files): of rows with ``outdated``, how many files have each kind."""
    return rows.agg(F.countDistinct(F.when(F.col("outdated.symbol"), F.col("path"))).alias("symbol_files"), F.countDistinct(F.when(F.col("outdated.binary"), F.col("path"))).alias("binary_files"))
