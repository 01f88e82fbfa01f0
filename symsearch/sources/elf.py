"""Symbols of ELF files.

A file's tables are decoded in the task that reads it.  What relates its rows,
which symbol a relocation lies in, is a join of two frames
(:mod:`symsearch.operators.relocations`), not a loop over one.
"""

from __future__ import annotations

import os
import struct
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symsearch.operators.checkpoints import checkpointed
from symsearch.operators.relocations import reference_lists
from symsearch.plans.symbols import MACHINES, SYMBOL, SYMBOL_TYPES

MAGIC = b"\x7fELF"
SHT_SYMTAB, SHT_RELA, SHT_REL, SHT_DYNSYM = 2, 4, 9, 11
SHN_LORESERVE = 0xFF00


class ElfError(ValueError):
    """The file is not an ELF file that can be read."""


@dataclass
class Section:
    name: str
    kind: int
    offset: int
    size: int
    link: int
    info: int
    entry: int


class Elf:
    """The parts of an ELF file that hold symbols, either class and byte order."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC or len(data) < 52 or data[4] not in (1, 2) or data[5] not in (1, 2):
            raise ElfError("not an ELF file")
        self.data, self.wide, self.order = data, data[4] == 2, "<" if data[5] == 1 else ">"
        try:
            (machine,) = struct.unpack_from(f"{self.order}H", data, 18)
            self.arch = MACHINES.get(machine, "NONE")
            table, = struct.unpack_from(f"{self.order}{'Q' if self.wide else 'I'}", data, 40 if self.wide else 32)
            width, n, names = struct.unpack_from(f"{self.order}HHH", data, 58 if self.wide else 46)
            raw = [self._header(table + i * width) for i in range(n if table else 0)]
            self.sections = [Section(self._text(raw[names][2] + r[0]) if names < len(raw) else "", r[1], *r[2:]) for r in raw]
        except struct.error as e:
            raise ElfError(f"broken ELF file: {e}") from e

    def _header(self, at: int) -> tuple[int, int, int, int, int, int, int]:
        if self.wide:
            name, kind, _, _, offset, size, link, info, _, entry = struct.unpack_from(f"{self.order}IIQQQQIIQQ", self.data, at)
        else:
            name, kind, _, _, offset, size, link, info, _, entry = struct.unpack_from(f"{self.order}IIIIIIIIII", self.data, at)
        return name, kind, offset, size, link, info, entry

    def _text(self, at: int) -> str:
        return self.data[at : self.data.find(b"\0", at)].decode("utf-8", "replace")

    def section_name(self, index: int) -> str:
        """Of a real section; that of a reserved or missing one is empty."""
        return self.sections[index].name if 0 < index < min(len(self.sections), SHN_LORESERVE) else ""

    def symbols(self, table: Section) -> list[tuple[str, str, int, int, str]]:
        """(name, section, value, size, type) of each entry."""
        names = self.sections[table.link].offset
        out = []
        for at in range(table.offset, table.offset + table.size, table.entry or 1 << 62):
            if self.wide:
                name, info, _, index, value, size = struct.unpack_from(f"{self.order}IBBHQQ", self.data, at)
            else:
                name, value, size, info, _, index = struct.unpack_from(f"{self.order}IIIBBH", self.data, at)
            out.append((self._text(names + name), self.section_name(index), value, size, SYMBOL_TYPES.get(info & 15, "NOTYPE")))
        return out

    def relocations(self) -> Iterator[tuple[str, int, str]]:
        """(section, offset, target's name); a relocation against a section names that section's symbol ``""``."""
        for s in self.sections:
            if s.kind not in (SHT_REL, SHT_RELA):
                continue
            if s.link >= len(self.sections) or self.sections[s.link].kind not in (SHT_SYMTAB, SHT_DYNSYM):
                raise ElfError(f"{s.name} is not linked to a symbol table")
            symbols = self.symbols(self.sections[s.link])
            word = "Q" if self.wide else "I"
            for at in range(s.offset, s.offset + s.size, s.entry or 1 << 62):
                offset, info = struct.unpack_from(f"{self.order}{word}{word}", self.data, at)
                index = info >> (32 if self.wide else 8)
                yield self.section_name(s.info), offset, symbols[index][0] if index < len(symbols) else ""

    def tables(self) -> list[Section]:
        return [s for kind in (SHT_SYMTAB, SHT_DYNSYM) for s in self.sections if s.kind == kind]


def elf_of(symbols: list[tuple[str, str, int, int, int]], machine: int = 62, table: str = ".symtab") -> bytes:
    """A small ELF file (64 bits, low byte first) of symbols (name, section, value, size, type's code): for tests and examples."""
    sections = list(dict.fromkeys(s for _, s, *_ in symbols))
    names, entries = b"\0", struct.pack("<IBBHQQ", 0, 0, 0, 0, 0, 0)
    for name, section, value, size, kind in symbols:
        entries += struct.pack("<IBBHQQ", len(names), 16 | kind, 0, 1 + sections.index(section), value, size)
        names += name.encode() + b"\0"
    titles = b"\0"
    parts = [(s, 1, b"", 0, 0) for s in sections] + [(table, SHT_SYMTAB if table == ".symtab" else SHT_DYNSYM, entries, len(sections) + 2, 24), (".strtab", 3, names, 0, 0)]
    headers, body = struct.pack("<IIQQQQIIQQ", *(0,) * 10), b""
    for title, kind, data, link, entry in parts:
        headers += struct.pack("<IIQQQQIIQQ", len(titles), kind, 0, 0, 64 + len(body), len(data), link, 0, 1, entry)
        titles += title.encode() + b"\0"
        body += data
    headers += struct.pack("<IIQQQQIIQQ", len(titles), 3, 0, 0, 64 + len(body), len(titles) + 11, 0, 0, 1, 0)
    body += titles + b".shstrtab\0\0"
    first = MAGIC + bytes((2, 1, 1)) + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 1, machine, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, len(parts) + 2, len(parts) + 1)
    return first + body + headers


def is_elf(path: str) -> bool:
    """Whether a file can be read and begins like an ELF file."""
    try:
        with open(path, "rb") as f:
            return f.read(4) == MAGIC
    except OSError:
        return False


def has_magic(content: Column | str) -> Column:
    """The same of a column of contents."""
    return F.substring(content, 1, 4) == F.lit(MAGIC)


_ROW = "path string, kind string, ord long, arch string, name string, section string, address long, size long, type string, target string, error string"


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _ROW.split(", ")]
    held: list[tuple] = []
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            held += _entries(path, content)
            if len(held) >= 20_000:  # small files share a frame
                yield pd.DataFrame(held, columns=columns)
                held = []
    yield pd.DataFrame(held, columns=columns)


def _entries(path: str, content: bytes | None) -> list[tuple]:
    rows: list[tuple] = []
    try:
        if content is None:
            with open(path, "rb") as f:
                content = f.read()
        elf = Elf(bytes(content))
        signed = lambda n: n - (1 << 64) if n >> 63 else n
        for table in elf.tables():
            rows += [(path, "symbol", len(rows) + i, elf.arch, n, s, signed(v), signed(z), t, None, None) for i, (n, s, v, z, t) in enumerate(elf.symbols(table))]
        rows += [(path, "relocation", i, elf.arch, None, s, signed(o), None, None, target, None) for i, (s, o, target) in enumerate(elf.relocations())]
        return [*rows, (path, "file", 0, elf.arch, None, None, None, None, None, None, None)]
    except (ElfError, OSError, struct.error, IndexError) as e:
        return [(path, "error", 0, None, None, None, None, None, None, None, str(e))]


def read_entries(files: DataFrame) -> DataFrame:
    """Symbols, relocations and one row for each file (or its error) of a frame with a ``path`` column.

    A ``content`` column is decoded if there is one; else the tasks open the
    paths.  A file with an error has no other rows: it counts as not read.
    """
    content = F.col("content") if "content" in files.columns else F.lit(None).cast("binary")
    return files.select("path", content.alias("content")).mapInPandas(_decode, _ROW)


def stored_files(spark: SparkSession, folder: str, pattern: str = "*.{o,so}") -> DataFrame:
    """(path, mtime, content) of the ELF files in and below a folder of any store that Spark reads; times are exact to the millisecond."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.where(has_magic("content")).select("path", (F.unix_micros("modificationTime") * 1000).alias("mtime"), "content")


@F.pandas_udf(T.StringType())
def demangle(names: pd.Series) -> pd.Series:
    """The C++ name behind a mangled one, else null; one ``c++filt`` for a batch of names."""
    mangled = names.fillna("").str.startswith("_Z")
    out = pd.Series([None] * len(names), index=names.index, dtype=object)
    if mangled.any():
        asked = names[mangled]
        try:
            said = subprocess.run(["c++filt"], input="\n".join(asked) + "\n", capture_output=True, text=True, check=True).stdout.split("\n")
        except (OSError, subprocess.CalledProcessError):
            return out
        for i, name, plain in zip(asked.index, asked, said, strict=False):
            out[i] = plain if plain != name else None
    return out


def read_symbols(spark: SparkSession, files: DataFrame, *, demangle_names: bool = True, with_relocations: bool = False, min_symbol_size: int = 1, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols, errors) of the files in a frame of (path, mtime).

    Both symbol tables are read, and their common symbols are kept twice.  A
    readable file without a symbol that is large enough gives one empty row, so
    that an index knows it.  ``sources``: (binary, source) of a compilation database.
    """
    # decoded once: symbols, relocations, empty files and errors are read from what is written
    entries = checkpointed(read_entries(files))
    symbols = entries.where((F.col("kind") == "symbol") & (F.col("size") >= min_symbol_size) & (F.col("name").isNotNull()))
    whole = symbols.select("path", "ord", "arch", "name", "section", "address", "size", "type")
    if with_relocations:
        rel = entries.where("kind = 'relocation'").select(F.col("path").alias("file"), "section", F.col("address").alias("r_offset"), "target")
        sym = whole.select(F.col("path").alias("file"), "section", "address", "size", "ord", "name")
        lists = reference_lists(sym, rel, by_symbol=True).select(F.col("file").alias("path"), "ord", "relocations")
        whole = whole.join(lists, ["path", "ord"], "left")
    else:
        whole = whole.withColumn("relocations", F.lit(None).cast("array<string>"))
    empty = entries.where("kind = 'file'").join(symbols.select("path").distinct(), "path", "left_anti")
    empty = empty.select("path", F.lit(0).cast("long").alias("ord"), F.lit("NONE").alias("arch"), F.lit("").alias("name"), F.lit("").alias("section"), F.lit(0).cast("long").alias("address"), F.lit(0).cast("long").alias("size"), F.lit("NOTYPE").alias("type"), F.array().cast("array<string>").alias("relocations"))
    rows = whole.unionByName(empty).join(files.select("path", "mtime"), "path")
    if sources is not None:
        rows = rows.join(sources.select(F.col("binary").alias("path"), "source"), "path", "left")
    else:
        rows = rows.withColumn("source", F.lit(None).cast("string"))
    rows = rows.withColumn("demangled", demangle("name") if demangle_names else F.lit(None).cast("string"))
    rows = rows.withColumn("relocations", F.coalesce("relocations", F.array().cast("array<string>")))
    return rows.select(*SYMBOL.fieldNames()), entries.where("kind = 'error'").select("path", "error")


def stat_files(files: DataFrame, elf_only: bool = False) -> DataFrame:
    """(path, mtime in nanoseconds) of the files in a frame with a ``path`` column, 0 for a missing one; ``elf_only``: of the ELF files alone.

    The tasks look, where the files must be, as they are when they are read.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p in batch["path"]:
                if elf_only and not is_elf(p):
                    continue
                try:
                    rows.append((p, os.stat(p).st_mtime_ns))
                except OSError:
                    rows.append((p, 0))
            yield pd.DataFrame(rows, columns=["path", "mtime"])

    return files.select("path").mapInPandas(look, "path string, mtime long")
