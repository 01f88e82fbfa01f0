"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: About this many bytes of text are turned into arrays at a time.
CHUNK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, as in tests on one machine, a temporary folder is set.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="symsearch-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs no recomputation of what came
    before, and branches that read the table do not run its plan twice.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/symsearch-{spark.sparkContext.applicationId}-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` from which nothing will be read any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def clear_tables(spark: SparkSession) -> None:
    """Delete all tables that :func:`written` has made in this application: once nothing that reads them is needed."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, f"symsearch-{spark.sparkContext.applicationId}-*")) or []:
        fs.delete(found.getPath(), True)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def chunks(items: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``items`` that hold about ``most`` bytes, one item at least."""
    start = size = 0
    for i, t in enumerate(items):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(items):
        yield start, len(items)


def unused(name: str, columns: list[str]) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def as_type(schema, name: str) -> str:
    return schema[name].dataType.simpleString()
