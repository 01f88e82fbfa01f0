"""SimHash near-duplicates found by covering locality-sensitive hashing.

A random map sends each of the 64 bits to a vector of r+1 bits.  Each non-zero
vector v gives a mask: the bits whose vector has an odd product with v.  For any
r bits there is a v whose products with their vectors all are even, since r
equations in r+1 unknowns have another solution than zero.  So two fingerprints
that differ in r bits or fewer agree on all bits of at least one mask: the
2^(r+1)-1 tables find every pair, not only most.

Exact copies are one fingerprint with many documents; links are sought between
distinct fingerprints.  A bucket of more than BUCKET fingerprints is not
compared pair by pair: its members go through covering masks over the bits that
the bucket leaves free, and so on.  Each level fixes over half of the free bits,
so the smallest buckets have few members by construction, whatever the data are.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symsearch.llm.common import LOWER, as_type, chunks, texts, written
from symsearch.llm.components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
BUCKET = 48

#: Eight counters of a byte each, one for each bit of a byte.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of the shingles of ``size`` words; of all words if there are fewer; none of no words."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    line, end, ends = b" ".join(words), -1, []
    for w in words:
        end += len(w) + 1
        ends.append(end)
    starts = [0, *(e + 1 for e in ends[: max(0, len(words) - size)])]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[min(size, len(words)) - 1 :], strict=True)]


def fingerprints(texts_: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """A fingerprint for each text: the bits set in over half of its shingles' hashes."""
    hashes: list[int] = []
    counts = np.zeros(len(texts_), np.int64)
    for i, t in enumerate(texts_):
        own = shingle_hashes(t, size)
        counts[i] = len(own)
        hashes += own
    ones = np.zeros((len(texts_), 64), np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        begins = (np.cumsum(counts) - counts)[full]
        # a lane holds a byte: add at most 255 hashes at a time
        parts = -(-counts[full] // 255)
        owner = np.repeat(np.arange(len(full)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = begins[owner] + 255 * nth
        raw = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            sums = np.add.reduceat(_LANES[raw[:, b]], at).view(np.uint8).reshape(-1, 8)
            ones[full, 8 * b : 8 * b + 8] = np.add.reduceat(sums.astype(np.int64), np.searchsorted(owner, np.arange(len(full))), axis=0)
    bits = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def covering_masks(bits: list[int], radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """Masks over the given bit numbers, one of which misses any ``radius`` of them."""
    rng = random.Random(seed)
    vectors = 1 << (radius + 1)
    order = [*bits]
    rng.shuffle(order)
    to = {b: 1 + i % (vectors - 1) for i, b in enumerate(order)}  # balanced: each non-zero vector as often
    return [sum(1 << b for b in bits if (to[b] & v).bit_count() % 2) for v in range(1, vectors)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bits(mask: int) -> list[int]:
    return [b for b in range(64) if mask >> b & 1]


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """All pairs (a, b), a < b as signed longs, of the distinct longs in ``prints.f`` that differ in at most ``radius`` bits, each at least once."""
    found = None
    # of each table: the bits that its buckets fix, and the masks to try next
    tables = {0: (0, covering_masks([*range(64)], radius))}
    rows = prints.select("f", F.lit(0).alias("t"))
    while True:
        fixed: dict[int, int] = {}
        after: dict[int, list[int]] = {}
        for t, (base, masks) in tables.items():
            for m in masks:
                after.setdefault(t, []).append(n := len(fixed))
                fixed[n] = base | m
        choices = F.create_map(*(x for t, ns in after.items() for x in (F.lit(t), F.array(*(F.struct(F.lit(n).alias("t"), F.lit(_signed(fixed[n])).cast("long").alias("m")) for n in ns))))) if len(after) > 1 else None
        one = F.array(*(F.struct(F.lit(n).alias("t"), F.lit(_signed(m)).cast("long").alias("m")) for n, m in fixed.items())) if choices is None else choices[F.col("t")]
        keyed = rows.select("f", F.explode(one).alias("x")).select("f", F.col("x.t").alias("t"), F.col("f").bitwiseAND(F.col("x.m")).alias("key"))
        # collect_list stops being used where the count says that the bucket is large
        sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = written(keyed.join(sizes, ["t", "key"]), "buckets")
        small = shared.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.array_sort(F.collect_list("f")).alias("fs"))
        pairs = small.select(F.posexplode("fs").alias("i", "a"), "fs").select("a", F.explode(F.filter(F.slice("fs", F.col("i") + 2, F.lit(bucket)), lambda b: F.bit_count(F.col("a").bitwiseXOR(b)) <= radius)).alias("b"))
        found = pairs if found is None else found.union(pairs)
        large = shared.where(F.col("n") > bucket).select("f", "t").distinct()
        used = [r.t for r in large.select("t").distinct().collect()]
        if not used:
            return found
        # a third level leaves five free bits, so at most 32 members: it ends there
        tables = {t: (fixed[t], covering_masks(_bits(~fixed[t] & (1 << 64) - 1), radius)) for t in used}
        rows = large


def printed(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """(doc, f) of each row; f: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = texts(batch.column(1))
            for a, b in chunks(all_texts):
                f = fingerprints(all_texts[a:b], size).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(f)], names=["doc", "f"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {as_type(docs.schema, id_col)}, f long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(id, ``fingerprint``, ``component_id``) of each row of ``docs``.

    A null or wordless text has the fingerprint zero, linked like any other.
    ``component_id`` is the smallest id that links lead to.  Rows with one id are
    one document.  A row with a null id gets the component of its fingerprint,
    or null if no row with an id has it, and links no others.
    """
    prints = written(printed(docs, id_col, text_col, size), "prints")
    classes = written(prints.where("doc is not null").groupBy("f").agg(F.min("doc").alias("rep")), "classes")
    pairs = links(classes, radius, bucket)
    left, right = classes.select(F.col("f").alias("a"), F.col("rep").alias("ra")), classes.select(F.col("f").alias("b"), F.col("rep").alias("rb"))
    edges = pairs.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # an id with several texts ties their fingerprints together
    several = written(prints.where("doc is not null").groupBy("doc").agg(F.min("f").alias("m"), F.max("f").alias("n")).where("m <> n").select("doc"), "several")
    own = prints.join(several, "doc", "left_semi").join(classes, "f").where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")).distinct()
    found = components(edges.union(own))
    of_class = classes.join(found, classes["rep"] == found["id"], "left").select("f", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of_class, "f", "left").select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id, with all its columns, as it is.

    Rows with a null id all stay.  Of rows that repeat an id, one stays (the
    one whose text is first in order).
    """
    near = written(near_duplicates(docs, id_col=id_col, text_col=text_col, size=size, radius=radius), "near")
    gone = written(near.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    left = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    again = near.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col)
    if again.isEmpty():
        return left
    again = written(again, "again")
    # the least text, found by each task first: an id may be most rows'
    row, text = F.struct(*docs.columns), F.col(text_col)
    one = left.join(again, id_col, "left_semi").groupBy(id_col).agg(F.min_by(row, F.struct(text.isNotNull(), text)).alias("r")).select("r.*")
    return left.join(again, id_col, "left_anti").select(*docs.columns).union(one)
