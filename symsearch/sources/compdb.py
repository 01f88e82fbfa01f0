"""Compilation databases: which source a binary comes from."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "directory string, file string, output string, command string, arguments array<string>"


def find(path: str) -> str | None:
    """The nearest ``compile_commands.json`` in a directory or above it."""
    at = os.path.abspath(path)
    while True:
        if os.path.isfile(found := os.path.join(at, "compile_commands.json")):
            return found
        if (up := os.path.dirname(at)) == at:
            return None
        at = up


def output(entry_directory: Column) -> Column:
    """The output an entry names: of its output, its command's last ``-o``, or its arguments' first, whichever key is there first; else the source's stem with ``.o``."""
    argument = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("arguments") - 2, F.lit(0))), lambda i: F.when(F.get("arguments", i) == "-o", F.get("arguments", i + 1))), lambda x: x.isNotNull()), F.lit(0))
    named = F.when(F.col("output").isNotNull(), F.col("output")).when(F.col("command").isNotNull(), F.nullif(F.regexp_extract("command", r"(?s).* -o *([^ ]+)", 1), F.lit(""))).when(F.col("arguments").isNotNull(), argument)
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(named, F.concat(entry_directory, F.lit("/"), stem, F.lit(".o")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(binary, source) of a database; of several entries for one binary the last counts."""
    entries = spark.read.schema(ENTRY).json(path, multiLine=True).withColumn("nth", F.monotonically_increasing_id())
    return resolve(entries, os.path.dirname(os.path.abspath(path)))


def resolve(entries: DataFrame, directory: str) -> DataFrame:
    """The same of entries with their ordinal ``nth``; ``directory``: where relative ones without their own begin."""
    where = F.coalesce("directory", F.lit(directory))
    below = lambda c: F.when(c.startswith("/"), c).otherwise(F.concat(where, F.lit("/"), c))
    rows = entries.select(below(output(where)).alias("binary"), below(F.col("file")).alias("source"), "nth")
    last = Window.partitionBy("binary").orderBy(F.desc("nth"))
    return rows.withColumn("k", F.row_number().over(last)).where("k = 1").select("binary", "source")


def resolved(database: DataFrame, told: DataFrame) -> DataFrame:
    """(binary, source): what the database says, else what is told by debug information (binary, source)."""
    return database.unionByName(told.join(database.select("binary"), "binary", "left_anti"))


def sources_of(binaries: DataFrame, database: DataFrame) -> DataFrame:
    """``binaries`` (path) with the source of each, null if the database has none."""
    return binaries.join(database.withColumnRenamed("binary", "path"), "path", "left")
