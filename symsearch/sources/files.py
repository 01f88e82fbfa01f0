"""Sources of files to index, and what is excluded from them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symsearch.functions.terms import glob_regex
from symsearch.sources import compdb

DEFAULT_GLOBS = ("**/*.o", "**/*.so")


class FileSource:
    """A frame with a ``path`` column, below a root."""

    def paths(self, spark: SparkSession, root: str) -> DataFrame:
        raise NotImplementedError


@dataclass
class StaticSource(FileSource):
    """The files of a list."""

    files: list[str]

    def paths(self, spark: SparkSession, root: str) -> DataFrame:
        return spark.createDataFrame([(os.path.join(root, f),) for f in self.files], "path string")


@dataclass
class FrameSource(FileSource):
    """The files of a frame with a ``path`` column: a list of any length, from any store that Spark reads."""

    files: DataFrame

    def paths(self, spark: SparkSession, root: str) -> DataFrame:
        path = F.col("path")
        return self.files.where(path.isNotNull()).select(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path)).alias("path"))


@dataclass
class GlobSource(FileSource):
    """Files whose path below the root matches a glob, or whose whole path does if the glob is absolute; ``**`` crosses directories."""

    globs: tuple[str, ...] = DEFAULT_GLOBS

    def paths(self, spark: SparkSession, root: str) -> DataFrame:
        below = tuple(g for g in self.globs if not os.path.isabs(g))
        out = _found(spark, root, below, root)
        for g in self.globs:
            if os.path.isabs(g):
                # from the last folder before the first sign of a pattern on
                out = out.union(_found(spark, os.path.dirname(re.split(r"[*?\[{]", g)[0]), (g,), "/"))
        return out.distinct()


def _found(spark: SparkSession, folder: str, globs: tuple[str, ...], root: str) -> DataFrame:
    """(path) of the files in and below a folder whose part below ``root`` matches a glob (the whole path for ``/``); each of its folders is walked by a task."""
    top = next(os.walk(folder), (folder, [], []))
    starts = [(folder, False), *((p, True) for d in sorted(top[1]) if not os.path.islink(p := os.path.join(folder, d)))]
    pattern = "|".join(f"(?:{glob_regex(g)})" for g in globs) or "(?!)"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, found = re.compile(pattern), []
        for batch in batches:
            for start, deep in zip(batch["path"], batch["deep"], strict=True):
                for d, folders, names in os.walk(start):
                    paths = [os.path.join(d, f) for f in names]
                    found += [p for p in paths if wanted.match(p if root == "/" else os.path.relpath(p, root))]
                    if not deep:
                        folders.clear()
                    if len(found) >= 10_000:
                        yield pd.DataFrame({"path": found}, dtype=object)
                        found = []
        yield pd.DataFrame({"path": found}, dtype=object)

    rows = spark.createDataFrame(starts, "path string, deep boolean")
    return rows.repartition(min(len(starts), 64)).mapInPandas(walk, "path string")


@dataclass
class CompilationDatabaseSource(FileSource):
    """The binaries of the nearest compilation database."""

    def paths(self, spark: SparkSession, root: str) -> DataFrame:
        found = compdb.find(root)
        if found is None:
            raise FileNotFoundError(f"no compile_commands.json in {root} or above it")
        return compdb.read(spark, found).select(F.col("binary").alias("path"))


@dataclass
class CombinedSource(FileSource):
    """The union of sources, each file once."""

    sources: list[FileSource] = field(default_factory=list)

    def paths(self, spark: SparkSession, root: str) -> DataFrame:
        out = spark.createDataFrame([], "path string")
        for s in self.sources:
            out = out.union(s.paths(spark, root))
        return out.distinct()


def first_exclusion(path: Column | str, patterns: list[str], root: str = "") -> Column:
    """The number of the first pattern that matches a path, or its part below the root; null: none does."""
    path = F.col(path) if isinstance(path, str) else path
    below = F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)) if root else path
    tests = [F.when(path.rlike(r := glob_regex(p)) | F.coalesce(below.rlike(r), F.lit(False)), i) for i, p in enumerate(patterns)]
    return F.coalesce(*tests) if tests else F.lit(None).cast("int")


def exclude(files: DataFrame, patterns: list[str], root: str = "") -> DataFrame:
    return files.where(first_exclusion("path", patterns, root).isNull())


def exclusion_stats(files: DataFrame, patterns: list[str], root: str = "") -> DataFrame:
    """(pattern, n): how many files each pattern is charged with, 0 included."""
    hits = files.select(first_exclusion("path", patterns, root).alias("i")).where("i is not null").groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    names = files.sparkSession.createDataFrame(list(enumerate(patterns)), "i int, pattern string")
    return names.join(hits, "i", "left").select("pattern", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
