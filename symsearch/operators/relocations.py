"""Which symbol a relocation lies in: an as-of join with an interval check.

In each section the symbol before an offset is the last of those with the
highest address below it, and the symbol after it the first of those with the
lowest address at or above it.  The owner is the first of both that covers the
offset; so the one after it can only own it if it begins just there.  One pass
over the union of symbols and offsets, ordered within each section, finds both:
no pair of a symbol and an offset that don't belong together is ever made, and
rows are dealt and sorted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symsearch.functions.terms import unsigned_order


def owners(symbols: DataFrame, relocations: DataFrame) -> DataFrame:
    """(file, section, r_offset, target, ord, name): the owner of each relocation that has one.

    ``symbols``: (file, section, address, size, ord, name); ``relocations``:
    (file, section, r_offset, target).  ord: a symbol's place in its file.
    """
    # addresses are unsigned: as longs that are ordered as they are
    address = unsigned_order("address")
    sym = F.struct(address.alias("address"), "ord", "size", "name")
    s = symbols.select("file", "section", address.alias("at"), F.lit(0).alias("kind"), F.col("ord").alias("tie"), sym.alias("sym"), F.lit(None).cast("string").alias("target"))
    r = relocations.select("file", "section", unsigned_order("r_offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("tie"), F.lit(None).cast(s.schema["sym"].dataType).alias("sym"), "target")
    # an offset stands behind the symbols at its address
    earlier = Window.partitionBy("file", "section").orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = s.union(r).withColumn("before", F.last("sym", ignorenulls=True).over(earlier))
    first_there = F.col("sym").isNotNull() & (F.col("before").isNull() | (F.col("before.address") < F.col("at")))
    rows = rows.withColumn("there", F.last(F.when(first_there, F.struct(F.col("before").alias("p"), F.col("sym").alias("q"))), ignorenulls=True).over(earlier))
    same = F.col("before.address") == F.col("at")
    near = rows.where("kind = 1 and before is not null").select("file", "section", "at", "target", F.when(same, F.col("there.p")).otherwise(F.col("before")).alias("p"), F.when(same, F.col("there.q")).alias("q"))
    covers = lambda c: F.col("at") < F.col(f"{c}.address") + F.col(f"{c}.size")
    found = near.withColumn("owner", F.when(covers("p"), F.col("p")).when(covers("q"), F.col("q"))).where("owner is not null")
    return found.select("file", "section", unsigned_order("at").alias("r_offset"), "target", F.col("owner.ord").alias("ord"), F.col("owner.name").alias("name"))


def reference_lists(symbols: DataFrame, relocations: DataFrame, by_symbol: bool = False) -> DataFrame:
    """(file, name, relocations): the distinct names, sorted, that each symbol refers to; ``by_symbol``: by its ``ord`` instead."""
    key = "ord" if by_symbol else "name"
    return owners(symbols, relocations).groupBy("file", key).agg(F.array_sort(F.collect_set("target")).alias("relocations"))
