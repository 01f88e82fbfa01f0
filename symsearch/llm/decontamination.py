"""Benchmark decontamination with suffix arrays over the training text.

Every task turns its documents into shards of some megabytes, builds a suffix
array over the words of each shard and binary-searches every suffix of the
benchmark in it, all suffixes at once, one word deeper at each step.  What a
suffix has matched when its range gets empty is its longest verbatim match, and
the range before that holds the locations.

The array leaves out positions at which no window of the benchmark can start:
a window's words all are benchmark words, each pair of neighbours among them
occurs side by side in the benchmark, and the chain of such pairs must be as
long as the shortest window that begins with the position's word.  This never
loses a match; it makes the array as small as the suspicious text.

No row is shuffled.  The benchmark goes to the executors in blocks of bounded
size; a task holds one of them at a time, so a larger benchmark takes longer, and
not more memory.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symsearch.llm.common import as_type, chunks, texts

WINDOW = 13
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z; what is no digit, letter or non-ASCII byte becomes a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class BenchmarkBlock:
    """The suffixes of some benchmark items, as numbers of their words."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray  #: words of all items, -1 after each
    starts: np.ndarray  #: of each suffix that begins with a window, in ``ids``
    lengths: np.ndarray  #: of those windows
    items: list[str]  #: of those windows
    shortest: np.ndarray  #: by word: the shortest window that begins with it
    pairs: np.ndarray  #: sorted numbers of neighbouring words

    @classmethod
    def build(cls, rows: list[tuple[object, bytes]], window: int = WINDOW) -> BenchmarkBlock:
        vocabulary: dict[bytes, int] = {}
        ids: list[int] = []
        windows: list[tuple[int, int, str]] = []
        for item, text in rows:
            own = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            at, length = len(ids), min(window, len(own))
            ids += [*own, -1]
            windows += [(at + i, length, str(item)) for i in range(len(own) - length + 1 if own else 0)]
        v = len(vocabulary)
        all_ids = np.array(ids, np.int64)
        starts = np.array([w[0] for w in windows], np.int64)
        lengths = np.array([w[1] for w in windows], np.int64)
        shortest = np.full(v + 1, np.iinfo(np.int64).max)
        if windows:
            np.minimum.at(shortest, all_ids[starts], lengths)
        left, right = all_ids[:-1], all_ids[1:]
        both = (left >= 0) & (right >= 0)
        return cls(vocabulary, all_ids, starts, lengths, [w[2] for w in windows], shortest, np.unique(left[both] * (v + 1) + right[both]))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of ``text`` in order, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1 or step >= n:
            return order


def _bound(values: np.ndarray, sa: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, above: bool) -> np.ndarray:
    """For each range of the suffix array the first place whose word at ``depth`` is not below (or is above) ``key``."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        word = values[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, len(values) - 1)]  # closed ranges may point anywhere
        less = open_ & ((word <= key) if above else (word < key))
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


def search(values: np.ndarray, sa: np.ndarray, block: BenchmarkBlock) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Search every suffix of the block.

    Returns for each place of the suffix array the longest verbatim match that
    starts there (0: none as long as a window), and (window, lo, hi) for each
    window that occurs.
    """
    best = np.zeros(len(sa), np.int64)
    occurring: list[tuple[int, int, int]] = []
    which = np.arange(len(block.starts))
    lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(sa))
    depth = 0
    while len(which):
        key = block.ids[block.starts[which] + depth]
        which, lo, hi, key = (x[key >= 0] for x in (which, lo, hi, key))
        first = _bound(values, sa, depth, lo, hi, key, above=False)
        last = _bound(values, sa, depth, first, hi, key, above=True)
        some = first < last
        which, lo, hi, depth = which[some], first[some], last[some], depth + 1
        whole = block.lengths[which] == depth
        occurring += zip(which[whole].tolist(), lo[whole].tolist(), hi[whole].tolist(), strict=True)
        long = block.lengths[which] <= depth
        if long.any():
            edges = np.zeros(len(sa) + 1, np.int64)
            np.add.at(edges, lo[long], 1)
            np.add.at(edges, hi[long], -1)
            best[np.cumsum(edges[:-1]) > 0] = depth
    return best, occurring


def _suspects(ids: np.ndarray, block: BenchmarkBlock) -> np.ndarray:
    """A mask of the words that belong to a chain in which a window can start."""
    v = len(block.vocabulary)
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    at = np.flatnonzero(both)
    pair = ids[at] * (v + 1) + ids[at + 1]
    linked = np.zeros(len(ids), bool)  # to the next word
    if len(block.pairs):
        place = np.minimum(np.searchsorted(block.pairs, pair), len(block.pairs) - 1)
        linked[at[block.pairs[place] == pair]] = True
    ends = np.flatnonzero(~linked)
    run = ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids)) + 1
    starts = np.flatnonzero((ids >= 0) & (run >= block.shortest[ids]))
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + run[starts], -1)
    return np.cumsum(edges[:-1]) > 0


def match_shard(documents: list[list[bytes]], blocks: list[BenchmarkBlock]) -> tuple[list[np.ndarray], list[set[str]], list[int]]:
    """For each document a mask of its hit words, the items with occurring windows, and its longest match."""
    sizes = np.array([len(d) + 1 for d in documents], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    total = int(begins[-1])
    hit = np.zeros(total, bool)
    items: list[set[str]] = [set() for _ in documents]
    longest = np.zeros(len(documents), np.int64)
    for block in blocks:
        get = block.vocabulary.get
        ids = np.fromiter((i for d in documents for i in (*[get(w, -1) for w in d], -1)), np.int64, total)
        suspect = _suspects(ids, block)
        if not suspect.any():
            continue
        # the suspicious runs, one after another, each ended by a number of its own
        place = np.flatnonzero(suspect)
        new = np.concatenate(([True], np.diff(place) > 1))
        run = np.cumsum(new) - 1
        target = np.arange(len(place)) + run
        values = np.full(len(place) + int(run[-1]) + 1, -1, np.int64)
        values[target] = ids[place]
        gaps = np.flatnonzero(values < 0)
        values[gaps] = -1 - np.arange(len(gaps))
        origin = np.full(len(values), -1, np.int64)
        origin[target] = place
        sa = suffix_array(values)
        best, occurring = search(values, sa, block)
        found = np.flatnonzero(best)
        where, length = origin[sa[found]], best[found]
        edges = np.zeros(total + 1, np.int64)
        np.add.at(edges, where, 1)
        np.add.at(edges, where + length, -1)
        hit |= np.cumsum(edges[:-1]) > 0
        np.maximum.at(longest, np.searchsorted(begins, where, side="right") - 1, length)
        ranges: dict[tuple[int, int], set[str]] = defaultdict(set)
        for w, lo, hi in occurring:
            ranges[lo, hi].add(block.items[w])
        for (lo, hi), names in ranges.items():
            for d in np.unique(np.searchsorted(begins, origin[sa[lo:hi]], side="right") - 1).tolist():
                items[d] |= names
    return [hit[b : b + n - 1] for b, n in zip(begins[:-1].tolist(), sizes.tolist(), strict=True)], items, longest.tolist()


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast blocks of the benchmark, each of about ``block_bytes`` of text at most.

    The size is looked up first; a benchmark beyond one block is dealt by a hash
    of the item, and only one block at a time is on the driver.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.encode(F.col(text_col), "UTF-8").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        block = BenchmarkBlock.build([(r.i, bytes(r.t)) for r in part.collect()], window)
        out.append(benchmark.sparkSession.sparkContext.broadcast(block))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, one_in: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: what it shares with the benchmark.

    Columns: the id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated``, ``longest_match`` (words), ``items`` and ``spans`` (start
    and length in words of each run of hit words).  A document is contaminated if
    at least one in ``one_in`` of its words is hit.

    A null or empty text has no words and is never contaminated; neither is a
    document when the benchmark is empty or holds no word.  Benchmark rows with
    a null text are left out, a null item id reads as ``None``.  Repeated rows
    give repeated results.  Other columns are not read.
    """
    shared = benchmark_blocks(benchmark, text_col=text_col, window=window, block_bytes=block_bytes)
    schema = f"doc {as_type(docs.schema, id_col)}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, items array<string>, spans array<struct<start:long,length:long>>"
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = texts(batch.column(1))
            for a, b, hits, items, longest in match_texts(all_texts, shared):
                n_words, n_hit = [len(h) for h in hits], [int(h.sum()) for h in hits]
                names = [sorted(s) for s in items]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(s) for s in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(s).encode()).hexdigest() for s in names]),
                        pa.array([h > 0 and one_in * h >= n for h, n in zip(n_hit, n_words, strict=True)]),
                        pa.array(longest, pa.int64()),
                        pa.array(names, pa.list_(pa.string())),
                        pa.array([_spans(h) for h in hits], spans_type),
                    ],
                    names=["doc", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "items", "spans"],
                )

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def match_texts(all_texts: list[bytes], shared: list, window_words=words) -> Iterator[tuple[int, int, list[np.ndarray], list[set[str]], list[int]]]:
    """For each shard (first, stop) of the texts what :func:`match_shard` finds, with all blocks.

    Texts are read anew for each block, and a block that isn't the only one is
    let go after that: it stays on the executor's disk.
    """
    shards = list(chunks(all_texts))
    found: list[tuple[list[np.ndarray], list[set[str]], list[int]]] = []
    for s in shared:
        for i, (a, b) in enumerate(shards):
            hits, items, longest = match_shard([window_words(t) for t in all_texts[a:b]], [s.value])
            if i == len(found):
                found.append((hits, items, longest))
            else:
                before = found[i]
                found[i] = ([x | y for x, y in zip(before[0], hits, strict=True)], [x | y for x, y in zip(before[1], items, strict=True)], [max(x) for x in zip(before[2], longest, strict=True)])
        if len(shared) > 1:
            s.__dict__.pop("_value", None)
    for (a, b), (hits, items, longest) in zip(shards, found, strict=True):
        yield a, b, hits, items, longest


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, one_in: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, as they are.

    The judgement is that of :func:`find_contamination`; rows with a null or
    empty text stay.
    """
    shared = benchmark_blocks(benchmark, window=window, block_bytes=block_bytes)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = texts(batch.column(at))
            for a, b, hits, _, _ in match_texts(all_texts, shared):
                yield batch.slice(a, b - a).filter(pa.array([not h.any() or one_in * int(h.sum()) < len(h) for h in hits]))

    return docs.mapInArrow(run, docs.schema)
