"""Keeping an index up to date from a stream of file states.

What an index run does once, a stream does for each batch of (path, mtime,
deleted) rows: stale rows go and fresh ones come in one write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symsearch.index import SymbolIndex


def latest(states: DataFrame) -> DataFrame:
    """The newest state of each file in a batch."""
    newest = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("deleted"))
    return states.withColumn("__k", F.row_number().over(newest)).where("__k = 1").drop("__k")


def apply_states(index: SymbolIndex, states: DataFrame, read: Callable[[DataFrame], DataFrame]) -> None:
    """``read`` turns (path, mtime) into symbols."""
    now = latest(states).cache()
    changed, deleted = now.where("not deleted").select("path", "mtime"), now.where("deleted").select("path")
    index.replace_files(read(changed), changed, deleted)
    now.unpersist()


def follow(states: DataFrame, index: SymbolIndex, read: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Apply all states there are, batch by batch; a batch that is applied again changes nothing."""
    return states.writeStream.foreachBatch(lambda batch, _: apply_states(index, batch, read)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
