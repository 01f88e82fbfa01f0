"""What other programs say of hits: disassembly and definitions."""

from __future__ import annotations

import re
import shlex
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symsearch.config import Config
from symsearch.functions.terms import end_address


def disassembly_command(row: dict, config: Config) -> list[str]:
    """The command for one hit, as arguments: nothing of the hit is read by a shell."""
    tools = config.for_machine(row["arch"])
    whole = {k: v % (1 << 64) if k in ("address", "endaddress") else v for k, v in row.items()}
    return [*shlex.split(tools.disassembler), *(a.format(**whole) for a in shlex.split(tools.disassembler_args))]


def disassemble(rows: DataFrame, config: Config) -> Iterator[tuple[dict, str | None]]:
    """(hit, output) of each hit in turn, None if the program failed; ends before the first hit whose file has changed."""
    for r in rows.withColumn("endaddress", end_address()).toLocalIterator():
        row = r.asDict(recursive=True)
        if row.get("outdated", {}).get("symbol"):
            return
        said = subprocess.run(disassembly_command(row, config), capture_output=True, text=True, check=False)
        yield row, said.stdout if said.returncode == 0 else None


def chosen_line(output: str, name: str, source: str | None) -> tuple[str | None, int | None]:
    """The file and line of a symbol in ``addr2line -f`` output: the pair with its name, else that with its source, else the first; (source, None) if it knows none."""
    lines = output.strip("\n").split("\n")
    pairs = list(zip(lines[::2], lines[1::2], strict=False))
    best = next((p for p in pairs if p[0] == name), None) or next((p for p in pairs if source and p[1].rpartition(":")[0] == source), None) or (pairs[0] if pairs else None)
    m = re.match(r"(.*):(\d+)(?: \(discriminator \d+\))?$", best[1]) if best else None
    return (m[1], int(m[2])) if m and not m[1].startswith("??") else (source, None)


def find_definitions(rows: DataFrame, config: Config) -> DataFrame:
    """(path, name, file, line) of hits; line 0 if only the source is known.  Programs run in the tasks, where the files must be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                command = [*shlex.split(config.for_machine(r.arch).addr2line), "-f", "-i", "-e", r.path, "-j", r.section, hex(r.address % (1 << 64))]
                try:
                    said = subprocess.run(command, capture_output=True, text=True, check=False).stdout
                except OSError:
                    said = ""
                file, line = chosen_line(said, r.name, r.source)
                out.append((r.path, r.name, file, line or 0))
            yield pd.DataFrame(out, columns=["path", "name", "file", "line"])

    return rows.select("arch", "path", "name", "section", "address", "source").mapInPandas(run, "path string, name string, file string, line long")


# The last name before the last directory in a compilation unit's dump.
DWARF_SOURCE = r"(?s).*DW_AT_name\s*\(?\"?([^\"\n)]*).*DW_AT_comp_dir\s*\(?\"?([^\"\n)]*)"


def dwarf_sources(files: DataFrame, program: str = "dwarfdump") -> DataFrame:
    """(path, source) from debug information, null if the program is missing or says nothing."""

    @F.pandas_udf(T.StringType())
    def dump(paths: pd.Series) -> pd.Series:
        out = []
        for p in paths:
            try:
                out.append(subprocess.run([program, p], capture_output=True, text=True, check=True).stdout)
            except (OSError, subprocess.CalledProcessError):
                out.append(None)
        return pd.Series(out, index=paths.index, dtype=object)

    said = files.select("path", dump("path").alias("d"))
    name, directory = F.regexp_extract("d", DWARF_SOURCE, 1), F.regexp_extract("d", DWARF_SOURCE, 2)
    return said.select("path", F.when(name == "", F.lit(None)).when(name.startswith("/"), name).otherwise(F.concat_ws("/", directory, name)).alias("source"))
