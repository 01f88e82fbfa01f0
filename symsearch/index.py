"""An index: a Parquet table of symbols, with the terms that searches need, and its metadata.

It lies in a folder of any file system that Spark knows.  Each write makes a new
version beside the old one and then a new metadata file that names it, numbered
one above the last: of two writers only one can make that file, readers always
see a whole version, and a failed write changes nothing.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symsearch.functions.terms import basename, name_terms, normalise_path, unsigned_order
from symsearch.operators import completion, fileset, ranking, tools
from symsearch.operators.checkpoints import checkpointed
from symsearch.plans import postings
from symsearch.plans.compiler import search
from symsearch.plans.fields import NameField, PathField, ReferencesField, Schema, SchemaError, path_columns, terms_column
from symsearch.plans.lexer import QueryError
from symsearch.plans.parser import Parser
from symsearch.plans.postings import RID
from symsearch.plans.symbols import DEFAULT_FIELDS, SCHEMA, SYMBOL
from symsearch.sources import compdb
from symsearch.sources.elf import read_symbols, stat_files
from symsearch.sources.files import CombinedSource, CompilationDatabaseSource, FileSource, GlobSource, StaticSource, exclude, exclusion_stats
from symsearch.sources.store import Store


class IndexProblem(RuntimeError):
    """Something about an index."""


class ClosedError(IndexProblem):
    """It has been closed."""


class ReadOnlyError(IndexProblem):
    """It was opened for reading."""


class DoesNotExistError(IndexProblem):
    """There is none."""


class TransactionInProgressError(IndexProblem):
    """A transaction is open already."""


class ModifiedError(IndexProblem):
    """Another writer was faster."""


#: Metadata files by number; the highest counts.
META = "_meta.{:010d}.json"
META_GLOB = "_meta.*.json"


@dataclass
class Options:
    demangle_names: bool = True
    index_relocations: bool = False
    min_symbol_size: int = 1
    use_dwarfdump: bool = True
    dwarfdump: str = "dwarfdump"
    num_processes: int = 0  #: tasks that read files; 0: as many as Spark likes


@dataclass
class Stats:
    changed: int = 0
    deleted: int = 0
    files: int = 0
    symbols: int = 0
    errors: list[tuple[str, str]] = field(default_factory=list)
    exclusions: dict[str, int] = field(default_factory=dict)


class SymbolIndex:
    """Open with :meth:`open`; close, or use it in a ``with``."""

    def __init__(self, spark: SparkSession, path: str, schema: Schema, readonly: bool) -> None:
        self.spark, self.store, self.schema, self.readonly = spark, Store(spark, path), schema, readonly
        self.path = self.store.path
        self._open, self._pending, self._base = True, None, None

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, readonly: bool = False, schema: Schema = SCHEMA) -> SymbolIndex:
        """Made if it isn't there and is opened for writing; a SchemaError if it was made with another schema."""
        index = cls(spark, path, schema, readonly)
        if not _metas(index.store):
            if readonly:
                raise DoesNotExistError(f"no index in {path}")
            index.store.make()
            index.store.put_new(META.format(1), json.dumps({"__schema__": schema.described(), "__data__": None}))
        if index._meta()["__schema__"] != json.loads(json.dumps(schema.described())):
            raise SchemaError(f"the index in {path} was made with another schema: delete it and index again")
        return index

    def close(self) -> None:
        self._open = False

    def __enter__(self) -> SymbolIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _meta(self) -> dict:
        return _last_meta(self.store)[1]

    def _change_meta(self, change: Callable[[dict], dict]) -> None:
        """Write what ``change`` makes of the metadata; again, if another writer was faster."""
        while True:
            n, meta = _last_meta(self.store)
            if self.store.put_new(META.format(n + 1), json.dumps(change(meta))):
                break
        for old in _metas(self.store)[:-3]:  # some stay for those who have just listed them
            self.store.delete(old)

    def _check(self, writing: bool = False) -> None:
        if not self._open:
            raise ClosedError("the index is closed")
        if writing and self.readonly:
            raise ReadOnlyError("the index was opened for reading")

    def get_metadata(self, key: str) -> str | None:
        self._check()
        if not key:
            raise ValueError("empty key")
        return self._meta().get("kv", {}).get(key)

    def metadata_keys(self) -> list[str]:
        self._check()
        return sorted(self._meta().get("kv", {}))

    def set_metadata(self, key: str, value: str) -> None:
        self._check(writing=True)
        if not key:
            raise ValueError("empty key")
        self._change_meta(lambda meta: {**meta, "kv": {**meta.get("kv", {}), key: value}})

    @property
    def binary_dir(self) -> str | None:
        return self.get_metadata("binary_dir")

    def rows(self) -> DataFrame:
        """The symbols, with the columns of their terms."""
        self._check()
        if self._pending is not None:
            return self._pending
        data = self._meta()["__data__"]
        return self.with_terms(self.spark.createDataFrame([], SYMBOL)).withColumn(RID, F.lit(0).cast("long")) if data is None else self.spark.read.parquet(self.store.child(f"{data}/rows"))

    def build_postings(self) -> None:
        """Write the postings of the version there is: searches for names use them until the next write."""
        self._check(writing=True)
        if data := self._meta()["__data__"]:
            postings.postings(self.rows(), self.schema).write.mode("overwrite").parquet(self.store.child(f"{data}/postings"))

    def _postings(self) -> DataFrame | None:
        data = None if self._pending is not None else self._meta()["__data__"]
        return self.spark.read.parquet(self.store.child(f"{data}/postings")) if data and self.store.exists(f"{data}/postings/_SUCCESS") else None

    def symbols(self) -> DataFrame:
        return self.rows().select(*SYMBOL.fieldNames())

    def with_terms(self, rows: DataFrame) -> DataFrame:
        for f in self.schema.values():
            if isinstance(f, ReferencesField):
                rows = rows.withColumn(terms_column(f.name), F.array_distinct(F.flatten(F.transform(f.columns[0], name_terms))))
            elif isinstance(f, NameField):
                rows = rows.withColumn(terms_column(f.name), name_terms(f.columns[0]))
            elif isinstance(f, PathField):
                plain, base = path_columns(f.columns[0])
                rows = rows.withColumn(plain, normalise_path(f.columns[0])).withColumn(base, basename(plain))
        return rows

    @contextmanager
    def transaction(self):
        """Changes are written when the block ends well, and dropped otherwise."""
        self._check(writing=True)
        if self._pending is not None:
            raise TransactionInProgressError("a transaction is open already")
        self._base = self._meta()["__data__"]
        self._pending = self.rows()
        try:
            yield self
            rows = self._pending
        finally:
            self._pending = None
        self._write(rows)

    def _write(self, rows: DataFrame) -> None:
        name = f"v-{uuid.uuid4().hex}"
        # sorted within files by path, so that row groups can be skipped
        rows.sortWithinPartitions("path", "address").withColumn(RID, F.monotonically_increasing_id()).write.parquet(self.store.child(f"{name}/rows"))
        oldest = None

        def moved(meta: dict) -> dict:
            nonlocal oldest
            if meta["__data__"] != self._base:
                self.store.delete(name)
                raise ModifiedError("another writer has changed the index")
            oldest = meta.get("__before__")
            return {**meta, "__data__": name, "__before__": self._base}

        self._change_meta(moved)
        # the version before stays for those who are reading it
        if oldest:
            self.store.delete(oldest)

    def _changed(self, change) -> None:
        self._check(writing=True)
        if self._pending is not None:
            self._pending = change(self._pending)
            return
        with self.transaction():
            self._pending = change(self._pending)

    def add_symbols(self, symbols: DataFrame) -> None:
        self._changed(lambda rows: rows.drop(RID).unionByName(self.with_terms(symbols.select(*SYMBOL.fieldNames()))))

    def replace_files(self, symbols: DataFrame, changed: DataFrame, deleted: DataFrame) -> None:
        """Rows of changed and deleted files go, ``symbols`` come, in one write."""
        self._changed(lambda rows: fileset.upsert(rows.drop(RID), self.with_terms(symbols), changed, deleted))

    def delete_files(self, files: DataFrame) -> None:
        self._changed(lambda rows: rows.join(files.select("path").distinct(), "path", "left_anti").select(*rows.columns))

    def mtime(self) -> int:
        return fileset.max_mtime(self.rows())

    def all_files(self) -> DataFrame:
        return fileset.distinct_files(self.rows())

    def rows_of(self, path: str) -> DataFrame:
        return self.symbols().where(F.col("path") == path)

    def parser(self) -> Parser:
        return Parser(self.schema, DEFAULT_FIELDS, auto_wildcard=True)

    def search(self, query: str, first: int = 0, limit: int | None = None, ranked: bool = False) -> DataFrame:
        """Symbols that match; ``ranked``: by relevance.  An empty query matches all."""
        query = query if query.strip() else "*:*"
        try:
            if ranked:
                return ranking.ranked(self.rows(), query, self.parser(), first=first, limit=limit).select(*SYMBOL.fieldNames(), "score")
            table = self._postings()
            rows = search(self.rows(), query, self.parser()) if table is None else postings.search(self.parser().parse(query), self.rows(), table, self.schema)
            rows = rows.select(*SYMBOL.fieldNames())
            if first or limit is not None:
                rows = rows.orderBy("path", unsigned_order("address"), "name").offset(first)
            return rows if limit is None else rows.limit(limit)
        except QueryError as e:
            raise self._hinted(query, e) from e

    def _hinted(self, query: str, error: QueryError) -> QueryError:
        """The error, with a hint if the whole query begins a name."""
        try:
            found = not search(self.rows(), json.dumps(query) + "*", self.parser()).limit(1).isEmpty()
        except QueryError:
            found = False
        return QueryError(f"{error}\nDid you forget to quote the demangled symbol name?") if found else error

    def complete(self, query: str, limit: int | None = None) -> list[str]:
        return completion.complete(self.rows(), query, self.parser(), limit)


def hits(index: SymbolIndex, query: str, limit: int | None = None) -> DataFrame:
    """Ranked hits with ``outdated``, ``index`` and ``total``."""
    rows = index.search(query, limit=limit, ranked=True)
    numbered = ranking.with_ordinals(rows, F.desc("score"), "path", unsigned_order("address"), "name").drop("score")
    named = numbered.select(F.explode(F.array("path", "source")).alias("path")).where("path is not null").distinct()
    return fileset.with_staleness(numbered, stat_files(named)).orderBy("index")


def _sources(spark: SparkSession, directory: str, changed: DataFrame, options: Options) -> DataFrame | None:
    """(binary, source): from the compilation database, else from debug information, else null."""
    database = compdb.find(directory)
    known = compdb.read(spark, database) if database else None
    if not (options.use_dwarfdump and shutil.which(options.dwarfdump)):
        return known
    told = tools.dwarf_sources(changed, options.dwarfdump).withColumnRenamed("path", "binary")
    return told if known is None else compdb.resolved(known, told)


def index_directory(spark: SparkSession, directory: str, index_path: str, *, options: Options | None = None, files: list[str] | None = None, extra_globs: tuple[str, ...] = (), use_compilation_database: bool = False, reindex: bool = False, exclusions: tuple[str, ...] = (), dry_run: bool = False) -> Stats | DataFrame:
    """Bring an index up to date with a directory; ``dry_run``: the plan (action, path) instead."""
    options, directory = options or Options(), os.path.realpath(directory)
    source: FileSource = CompilationDatabaseSource() if use_compilation_database else StaticSource(files) if files is not None else GlobSource()
    if extra_globs:
        source = CombinedSource([source, GlobSource(tuple(extra_globs))])
    with SymbolIndex.open(spark, index_path) as index:
        if index.binary_dir is None and not dry_run:
            index.set_metadata("binary_dir", directory)
        found = checkpointed(source.paths(spark, directory).distinct())
        charged = {r.pattern: r.n for r in exclusion_stats(found, list(exclusions), directory).collect()}
        # looked at once, so that all that follows sees the same files and times
        current = checkpointed(stat_files(exclude(found, list(exclusions), directory), elf_only=True))
        known = index.all_files()
        newest = 0 if reindex else index.mtime()
        changed = current if reindex else fileset.changed_files(current, known, newest)
        deleted = fileset.deleted_files(current, known)
        if dry_run:
            return fileset.plan(changed, deleted, known).orderBy("action", "path")
        changed, deleted = changed.cache(), deleted.cache()
        stats = Stats(changed=changed.count(), deleted=deleted.count(), exclusions=charged)
        if stats.changed or stats.deleted:
            sources = _sources(spark, directory, changed, options)
            dealt = changed.repartition(options.num_processes) if options.num_processes else changed
            symbols, errors = read_symbols(spark, dealt, demangle_names=options.demangle_names, with_relocations=options.index_relocations, min_symbol_size=options.min_symbol_size, sources=sources)
            stats.errors = [tuple(r) for r in errors.collect()]
            index.replace_files(symbols, changed, deleted)
            own = index.rows().join(changed.select("path"), "path", "left_semi")
            stats.files, stats.symbols = own.select("path").distinct().count(), own.where("name <> ''").count()
        changed.unpersist()
        deleted.unpersist()
        return stats


def _metas(store: Store) -> list[str]:
    return [n for n in store.names() if n.startswith("_meta.") and n.endswith(".json")]


def _last_meta(store: Store) -> tuple[int, dict]:
    name = _metas(store)[-1]
    return int(name.split(".")[1]), json.loads(store.read(name))


def delete_index(path: str, *, metadata_too: bool = False, dry_run: bool = False, spark: SparkSession | None = None) -> list[str]:
    """Delete an index's data (and its metadata); the paths that go, none if there is no index."""
    store = Store(spark or SparkSession.builder.getOrCreate(), path)
    metas = _metas(store)
    if not metas:
        return []
    gone = [n for n in store.names() if n.startswith("v-")] + (metas if metadata_too else [])
    if not dry_run:
        if not metadata_too:
            n, meta = _last_meta(store)
            if not store.put_new(META.format(n + 1), json.dumps({**meta, "__data__": None, "__before__": None})):
                raise ModifiedError("another writer has changed the index")
        for name in gone:
            store.delete(name)
    return [store.child(name) for name in gone]


def default_folder() -> str:
    """Where indexes are kept if nobody says."""
    return os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "symsearch", "index")


def default_path(directory: str) -> str:
    """Where the index of a directory is kept if nobody says."""
    return os.path.join(default_folder(), "!".join(os.path.realpath(directory).strip("/").split("/")))


def find_index(directory: str) -> str | None:
    """Of the indexes in the default folder that of a directory, or of the nearest one above it: by the directory that is stored in each."""
    asked, found = os.path.realpath(directory), {}
    for meta in sorted(glob.glob(os.path.join(glob.escape(default_folder()), "*", META_GLOB))):
        with open(meta) as f:
            of = json.load(f).get("kv", {}).get("binary_dir")
        if of and os.path.commonpath((of, asked)) == of:
            found[of] = os.path.dirname(meta)
    return found[max(found, key=len)] if found else None
