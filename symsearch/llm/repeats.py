"""Removal of every byte that lies in a long string which occurs elsewhere too.

A string of LENGTH bytes is a window.  Each window is owned by a mark: of the
positions at which its first SPAN grams start, the one whose gram hashes lowest.
Equal windows have their marks at the same place, so whatever a window equals is
owned by a mark with the same core, the bytes from the mark on that all windows
it may own contain.  This brings equal windows together without sending all:

1. each text is read once, to find its marks; of each, the hash of the core and
   that of its context (all windows that it owns) are kept;
2. cores that occur once are done: their windows occur once;
3. of the others, equal contexts are counted, and one of each goes, with whether
   it has copies, to the run-length index of its core, if that has any other;
4. the index (:mod:`symsearch.llm.run_length_index`), in which a core is one
   symbol, is a run-compressed transform of the contexts of some cores; its
   streamed match lengths mark the windows that also start elsewhere;
5. what it has marked goes back to all texts that have the context.

No group is gathered without a bound.  A task that has met a context twice needs
nobody to tell it that the context occurs again, so however many texts share a
passage, each task names it twice at most (``Seen``).  A core with more than
CORE_MOST different contexts is split: half of its windows reach at least SPAN / 2
bytes behind it, the others as many before it, and these bytes join the core.
This halves the span until the groups are small; at a span of one, equal windows
are equal cores.

The same is done with words in place of bytes for passages of PASSAGE words that
another row has too: these don't go, but rows with such a passage are told from
others.  There, each context is named once for a row, and copies are those of
different rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symsearch.llm.common import discard, texts, written
from symsearch.llm.run_length_index import RunLengthIndex

#: In bytes, and in words.  Spans are powers of two.
LENGTH, SPAN, GRAM = 400, 128, 32
PASSAGE, PASSAGE_SPAN, PASSAGE_GRAM = 50, 32, 8
#: Values of the short hash that is sent to all tasks.
BUCKETS = 1 << 20
#: An index holds about so many contexts, and so many of one core at most.
INDEX_CONTEXTS, CORE_MOST = 2048, 2048
#: Texts are hashed in blocks of about so many bytes, long ones piece by piece.
BLOCK = 1 << 17
#: A task remembers about so many contexts.
SLOTS = 1 << 19

_WRAP = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_NEXT_BLANK = re.compile(rb"[\t-\r ]")
_P = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 22) - 1)
_powers_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of _P and of its inverse, modulo 2^64."""
    size = max(BLOCK * 2, 1 << (n - 1).bit_length())
    if size not in _powers_of:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up, down = np.full(size, _P), np.full(size, inverse)
            up[0] = down[0] = 1
            _powers_of[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers_of[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any substrings of one block, from sums of its units' weighted values."""

    def __init__(self, units: np.ndarray) -> None:
        n = len(units)
        self.up, self.down = _powers(n + 1)
        with np.errstate(over="ignore"):
            weighted = _WRAP[units] if units.dtype == np.uint8 else units | np.uint64(1)
            weighted *= self.up[:n]
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(weighted, out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Of the substring of ``size`` units at each position."""
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            out = self.sums[size:] - self.sums[:n]
            out *= self.down[:n]
        return _mixed(out)

    def at(self, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[start + size] - self.sums[start]) * self.down[start])


def word_units(all_texts: list[bytes]) -> list[np.ndarray]:
    """A hash of each word of each text."""
    joined, out, starts, at = b"\n".join(all_texts), [], [], 0
    while at < len(joined):
        blank_at = _NEXT_BLANK.search(joined, at + BLOCK)  # a word isn't cut
        stop = blank_at.start() if blank_at else len(joined)
        piece = np.frombuffer(joined, np.uint8, stop - at, at)
        blank = np.concatenate(([True], _BLANK[piece], [True]))
        start = np.flatnonzero(blank[:-1] & ~blank[1:])
        out.append(Hasher(piece).at(start, np.flatnonzero(~blank[:-1] & blank[1:]) - start))
        starts.append(start + at)
        at = stop
    if not out:
        return [np.zeros(0, np.uint64) for _ in all_texts]
    ends = np.cumsum([len(t) + 1 for t in all_texts])[:-1]
    return np.split(np.concatenate(out), np.searchsorted(np.concatenate(starts), ends))


def marks(units: np.ndarray, ends: np.ndarray, length: int = LENGTH, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, left, core, context): the windows of each mark, by their starts, the units from the first start to the mark, and hashes of the core and of all its windows.

    ``units``: bytes, or hashes of words; ``ends``: where each text in the block
    ends; no window crosses an end.
    """
    none = np.zeros(0, np.int64)
    if len(units) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hasher = Hasher(units)
    lowest = hasher.all(min(gram, length - span + 1))
    lowest &= ~_PLACE
    lowest |= np.arange(len(lowest), dtype=np.uint64)
    step = 1
    while step < span:  # span is a power of two
        lowest = np.minimum(lowest[:-step], lowest[step:])
        step *= 2
    n = len(units) - length + 1
    owner = (lowest[:n] & _PLACE).astype(np.int64)
    # windows over an end are nobody's
    begins = np.concatenate(([0], ends[:-1]))
    cut = np.zeros(n + 1, np.int64)
    np.add.at(cut, np.minimum(begins, n), 1)
    np.add.at(cut, np.minimum(np.maximum(ends - length + 1, begins), n), -1)
    valid = np.cumsum(cut[:-1]) > 0
    change = np.concatenate(([True], (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])))
    # a text that is just a window long touches the next one's first window
    change[np.minimum(begins, n - 1)] = True
    first = np.flatnonzero(change)
    last = np.concatenate((first[1:] - 1, [n - 1]))
    first, last = first[valid[first]], last[valid[first]]
    if units.dtype == np.uint8:
        block, digest = units.tobytes(), xxhash.xxh3_64_intdigest
        context = np.array([digest(block[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
    else:
        context = hasher.at(first, last + length - first)
    return first, last, owner[first] - first, hasher.at(owner[first], length - span + 1), context


def blocks(all_units: list[np.ndarray], length: int) -> Iterator[tuple[list[np.ndarray], list[int], list[int]]]:
    """Blocks of texts, or of pieces of a long text: (pieces, row of each piece, its start in the text).

    Pieces of one text overlap by one unit less than a window, so that each
    window is in one of them.
    """
    rows: list[int] = []
    starts: list[int] = []
    held: list[np.ndarray] = []
    size = 0
    for i, t in enumerate(all_units):
        for s in range(0, max(1, len(t) - length + 1), BLOCK):
            piece = t[s : s + BLOCK + length - 1]
            rows.append(i)
            starts.append(s)
            held.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield held, rows, starts
                rows, starts, held, size = [], [], [], 0
    if held:
        yield held, rows, starts


class Seen:
    """Which contexts a task has met twice.

    A table with one slot for each short hash, so its size is fixed; a context
    that finds its slot taken is forgotten, and only that much is sent in vain.
    """

    def __init__(self, slots: int = SLOTS) -> None:
        self.context, self.times = np.zeros(slots, np.uint64), np.zeros(slots, np.int8)

    def twice(self, context: np.ndarray) -> np.ndarray:
        """Whether each was met twice before, those before it in the array included."""
        slot = (context % np.uint64(len(self.times))).astype(np.int64)
        before = np.where(self.context[slot] == context, self.times[slot], 0)
        order = np.argsort(context, kind="stable")
        new = np.concatenate(([True], context[order][1:] != context[order][:-1])) if len(order) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(len(order)) - head[np.cumsum(new) - 1]
        times = np.minimum(before[order[head]] + np.diff(np.append(head, len(order))), 2)
        kept, at = order[head], slot[order[head]]
        free = (self.times[at] < 2) | (self.context[at] == context[kept])
        self.context[at[free]], self.times[at[free]] = context[kept[free]], times[free]
        # (of two that take one slot at once the last one has it)
        return before + nth >= 2


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Consecutive values as a list for each of n rows; owner: the row of each, in order."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def mark_texts(all_units: list[np.ndarray], length: int, span: int, gram: int, seen: Seen, once: bool = False) -> dict[str, pa.Array]:
    """For each text lists with an entry for each of its marks: first, last, left, core, context; and first and last of those that the task has seen twice.

    ``once``: of equal contexts in one text the first stands for all.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for held, rows, starts in blocks(all_units, length):
        block, ends = np.concatenate(held), np.cumsum([len(h) for h in held])
        first, last, left, core, context = marks(block, ends, length, span, gram)
        piece = np.searchsorted(ends, first, side="right")
        shift = np.array(starts, np.int64)[piece] - (ends - [len(h) for h in held])[piece] if len(first) else first
        found.append((np.array(rows, np.int64)[piece] if len(first) else first, first + shift, last + shift, left, core, context))
    owner, first, last, left, core, context = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 6
    context = context.astype(np.uint64)
    if once:
        _, at = np.unique(np.stack((owner.astype(np.uint64), context)), axis=1, return_index=True) if len(owner) else (None, np.zeros(0, np.int64))
        owner, first, last, left, core, context = (x[np.sort(at)] for x in (owner, first, last, left, core, context))
    sure = seen.twice(context)
    new = ~sure
    lists = {"first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32)), "left": pa.array(left.astype(np.int16)), "core": _signed(core), "context": _signed(context)}
    out = {k: _lists(owner[new], len(all_units), v.filter(pa.array(new))) for k, v in lists.items()}
    return out | {f"sure_{k}": _lists(owner[sure], len(all_units), lists[k].filter(pa.array(sure))) for k in ("first", "last")}


def text_key(text_col: str = "text") -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text_col))


def _texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text) of the rows named by (key, id) in ``wanted``, an id as text.

    A filter by a short hash, of BUCKETS values at most, goes to all tasks and
    keeps most other texts out of the join.
    """
    short = F.pmod(F.xxhash64("key", "id"), F.lit(BUCKETS))
    named = docs.select(text_key(text_col).alias("key"), _id(id_col).alias("id"), F.col(text_col).alias("text"))
    few = F.broadcast(wanted.select(short.alias("b")).distinct())
    return named.withColumn("b", short).join(few, "b", "left_semi").join(wanted, ["key", "id"], "left_semi").select("key", "text")


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def _one_each(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id): of the rows of each key one; chosen before the join, as a key may have many rows."""
    return facts.groupBy("key").agg(F.min("id").alias("id")).join(keys, "key", "left_semi")


def text_facts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, key, n_bytes, sha256) of each row; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return written(docs.select(F.col(id_col).alias("doc"), _id(id_col).alias("id"), text.alias("text")).select("doc", "id", text_key("text").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")), "facts")


_LISTS = "first array<int>, last array<int>, left array<short>, core array<long>, context array<long>, sure_first array<int>, sure_last array<int>"


def _marked(batches: Iterator[pa.RecordBatch], sizes: dict[bool, tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Two rows for (key, text): its marks as bytes and, if asked for, as words; with a number of the row."""
    from pyspark import TaskContext

    copies: dict[bytes, int] = {}  # of the task's texts
    row = TaskContext.get().partitionId() << 40
    seen = {words: Seen() for words in sizes}
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            all_texts = texts(batch.column(1).slice(a, 1000))
            # whether a string occurs once or more often is all that counts: two copies say the same as a thousand
            keys, chosen = batch.column(0).slice(a, 1000), []
            for i, key in enumerate(keys.to_pylist()):
                copies[key] = n = copies.get(key, 0) + 1
                if n <= 2:
                    chosen.append(i)
            for words, (length, span, gram) in sizes.items():
                own = [all_texts[i] for i in chosen]
                units = word_units(own) if words else [np.frombuffer(t, np.uint8) for t in own]
                lists = mark_texts(units, length, span, gram, seen[words], once=words)
                numbers = pa.array(row + np.arange(len(chosen)))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(chosen, pa.int64())), numbers, pa.array([words] * len(chosen), pa.bool_()), *lists.values()], names=["key", "row", "words", *lists])
            row += len(chosen)


def repeated_spans(docs: DataFrame, facts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, span: int = SPAN, passage: int | None = PASSAGE, passage_span: int = PASSAGE_SPAN) -> DataFrame:
    """(key, spans, has_passage) of each distinct text that has repeats; spans: (start, stop) in bytes, which may overlap, or null."""
    sizes = {False: (length, span, GRAM), **({True: (passage, passage_span, PASSAGE_GRAM)} if passage else {})}
    # a passage has a byte and a blank for each word but the last
    long = docs.where(F.octet_length(text_col) >= min(length, 2 * passage - 1 if passage else length)).select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    lists = written(long.mapInArrow(partial(_marked, sizes=sizes), f"key binary, row long, words boolean, {_LISTS}"), "marks")
    # (2) cores that occur more than once
    # written, so that nothing stands between the join and its exchanges and Spark can split a core with many copies
    twice = written(lists.select(F.explode("core").alias("core")).groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "cores")
    each = lists.select("key", "row", "words", F.explode(F.arrays_zip("first", "last", "left", "core", "context")).alias("m")).select("key", "row", "words", "m.first", "m.last", "m.left", "m.core", "m.context")
    shared = written(each.join(twice, "core"), "shared-marks")
    sure = written(lists.select("key", "words", F.explode(F.arrays_zip(F.col("sure_first").alias("first"), F.col("sure_last").alias("last"))).alias("m")).select("key", "words", "m.first", "m.last"), "sure")
    discard(lists, twice)
    # (3) one text for each context
    copies = F.when(F.first("words"), F.min("row") != F.max("row")).otherwise(F.count(F.lit(1)) > 1)
    contexts = shared.groupBy("core", "context").agg(copies.alias("copies"), F.min(F.struct("key", "row", "first", "last", "left", "words")).alias("one"))
    contexts = written(contexts, "contexts")
    # a core with one context has nothing to be compared with: what has copies occurs again as a whole
    alone = written(contexts.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("core"), "alone")
    whole = contexts.join(alone, "core", "left_semi").where("copies").select("core", "context", F.lit(0).alias("a"), (F.col("one.last") - F.col("one.first")).alias("b"))
    others = contexts.join(alone, "core", "left_anti")
    asked = written(others.groupBy("one.key").agg(F.collect_list(F.struct("core", "context", "copies", "one.row", "one.first", "one.last", "one.left", "one.words")).alias("asked")), "asked")
    named = written(_one_each(facts, asked.select("key")), "asked-ids")
    chosen = _texts_of(docs, named, id_col, text_col).groupBy("key").agg(F.min("text").alias("text")).join(asked, "key")
    pieces = written(chosen.select("key", "text", "asked").mapInArrow(partial(_context_pieces, sizes=sizes), _PIECE), "pieces")
    discard(asked, named)
    # (4), (5)
    runs = written(_decided(pieces).union(whole), "runs")
    discard(pieces, contexts, alone)
    # a context has a run for each stretch of its windows that occurs elsewhere
    found = shared.select("key", "words", "core", "context", "first").join(runs, ["core", "context"]).select("key", "words", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last"))
    own = F.when(~F.col("words"), F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("stop")))
    out = written(found.union(sure).groupBy("key").agg(F.collect_set(own).alias("spans"), F.max("words").alias("has_passage")), "spans")
    discard(shared, runs, sure)
    return out


#: A context: its core, which windows it has, what is before and after the core, and how many windows a core can have.
#: ``at`` is the place of its first window in the context that was marked, which is named by the marked core and its context.
_PIECE = "core long, copies boolean, span int, words boolean, row long, head binary, tail binary, of_core long, of_context long, at int"
_PIECE_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def _context_pieces(batches: Iterator[pa.RecordBatch], sizes: dict[bool, tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """For (key, text, asked): what each context has before and after its core."""
    for batch in batches:
        lists = batch.column(2)
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        owners = np.repeat(np.arange(len(lists)), np.diff(offsets))
        at, text, as_words = -1, b"", b""
        for a in range(0, len(owners), 5000):
            part, rows = flat.slice(a, 5000), []
            columns = [part.field(k).to_pylist() for k in ("core", "context", "copies", "row", "first", "last", "left", "words")]
            for owner, core, context, copies, row, first, last, left, words in zip(owners[a : a + 5000].tolist(), *columns, strict=True):
                if owner != at:
                    at, text, as_words = owner, texts(batch.column(1).slice(owner, 1))[0], b""
                length, span, _ = sizes[words]
                if words and not as_words:
                    as_words = word_units([text])[0].tobytes()
                units, scale = (as_words, 8) if words else (text, 1)
                q, stop = first + left, last + length
                rows.append((core, copies, span, words, row, units[first * scale : q * scale], units[(q + length - span + 1) * scale : stop * scale], core, context, 0))
            yield _pieces(rows)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names=_PIECE_NAMES)


def _decided(pieces: DataFrame, most: int | None = None) -> DataFrame:
    """(core, context, a, b): of each marked context the runs of windows that occur elsewhere."""
    most = most or CORE_MOST
    out = None
    while True:
        crowded = written(pieces.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most).select("core"), "crowded")
        rest = pieces if (last := crowded.isEmpty()) else pieces.join(crowded, "core", "left_anti")
        runs = rest.repartition("core").sortWithinPartitions("core").mapInArrow(_indexed, "core long, context long, a int, b int")
        out = runs if out is None else out.union(runs)
        if last:
            return out
        halves = written(pieces.join(crowded, "core", "left_semi").select(*_PIECE_NAMES).mapInArrow(_halves, f"{_PIECE}, n int, part long"), "halves")
        # equal halves are copies of one entry: they are all told so, and one of them goes on
        copies = F.max("copies") | F.when(F.first("words"), F.min("row") != F.max("row")).otherwise(F.count(F.lit(1)) > 1)
        parts = written(halves.groupBy("core", "part").agg(copies.alias("copies"), F.count(F.lit(1)).alias("many"), F.min(F.struct(*_PIECE_NAMES[2:])).alias("one")), "parts")
        equal = halves.join(parts.where("many > 1 and copies").select("core", "part"), ["core", "part"])
        out = out.union(equal.select(F.col("of_core").alias("core"), F.col("of_context").alias("context"), F.col("at").alias("a"), (F.col("at") + F.col("n") - 1).alias("b")))
        pieces = parts.select("core", "copies", "one.*")


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each context as up to two: its windows with at least half a span after the core, and those with as much before it."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows, more = [], []
        for core, copies, span, words, row, head, tail, of_core, of_context, at in zip(*(batch.column(k).to_pylist() for k in _PIECE_NAMES), strict=True):
            unit = 8 if words else 1
            half, h = span // 2, len(head) // unit
            least = span - 1 - len(tail) // unit  # what the last window has before the core
            name = core.to_bytes(8, "little", signed=True)
            if least < half:
                skip = max(0, h - (half - 1))
                rows.append((_hash64(digest(name + b"a" + tail[: half * unit])), copies, half, words, row, head[skip * unit :], tail[half * unit :], of_core, of_context, at + skip))
                more.append(h - skip - least + 1)
            if h >= half:
                n = h - max(least, half) + 1
                rows.append((_hash64(digest(name + b"b" + head[(h - half) * unit :])), copies, half, words, row, head[: (h - half) * unit], tail[: (span - 1 - max(least, half)) * unit], of_core, of_context, at))
                more.append(n)
        out = _pieces(rows)
        part = [_hash64(digest(r[5] + b"/%d/" % len(r[5]) + r[6])) for r in rows]
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(more, pa.int32()), pa.array(part, pa.int64())], names=[*_PIECE_NAMES, "n", "part"])


def _hash64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def marked_windows(contexts: list[tuple[int, bool, int, int, np.ndarray, np.ndarray]], by_row: bool = False) -> list[list[tuple[int, int]]]:
    """For contexts (core, copies, span, row, head, tail), those of one core side by side: of each the runs of its windows that occur elsewhere.

    A window is ``span`` symbols, as its core is one; each context ends with a
    symbol of its own.  ``by_row``: only what another row has counts, and all
    spans are equal.
    """
    heads, tails = (np.array([len(c[i]) for c in contexts], np.int64) for i in (4, 5))
    sizes = heads + tails + 2
    begins = np.cumsum(sizes) - sizes
    names, flat = np.unique(np.concatenate([x for c in contexts for x in c[4:6]]), return_inverse=True)
    cores = np.array([c[0] for c in contexts])
    text = np.zeros(int(sizes.sum()), np.int64)
    rest = np.ones(len(text), bool)
    at, stop = begins + heads, begins + sizes - 1
    rest[at] = rest[stop] = False
    text[rest] = flat
    text[at] = len(names) + np.cumsum(np.concatenate(([False], cores[1:] != cores[:-1])))
    text[stop] = text[at[-1]] + 1 + np.arange(len(contexts))
    copies = np.array([c[1] for c in contexts])
    index = RunLengthIndex.build(text)
    if by_row:
        found = index.in_others(np.repeat([c[3] for c in contexts], sizes), contexts[0][2], np.repeat(copies, sizes))
    else:
        # what stands for several copies occurs again up to its end
        again = np.repeat(np.where(copies, stop, -1), sizes) - np.arange(len(text))
        found = index.longest_elsewhere(np.maximum(again, 0)) >= np.repeat([c[2] for c in contexts], sizes)
    out: list[list[tuple[int, int]]] = []
    for begin, size, c in zip(begins.tolist(), sizes.tolist(), contexts, strict=True):
        marked = found[begin : begin + size - c[2]]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0])))) if marked.any() else []
        out.append([(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)])
    return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core, context, a, b): the repeated windows of pieces that come sorted by core."""
    held: dict[bool, list[tuple]] = {False: [], True: []}

    def done(words: bool) -> pa.RecordBatch:
        own = held[words]
        rows = [(x[6], x[7], x[8] + a, x[8] + b) for x, runs in zip(own, marked_windows([x[:6] for x in own], by_row=words), strict=True) for a, b in runs]
        own.clear()
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["core", "context", "a", "b"])

    for batch in batches:
        for core, copies, span, words, row, head, tail, *of in zip(*(batch.column(k).to_pylist() for k in _PIECE_NAMES), strict=True):
            own, kind = held[words], np.uint64 if words else np.uint8
            # an index has one span, and whole cores
            if own and (own[0][2] != span or len(own) >= INDEX_CONTEXTS and core != own[-1][0]):
                yield done(words)
            own.append((core, copies, span, row, np.frombuffer(head, kind).astype(np.uint64), np.frombuffer(tail, kind).astype(np.uint64), *of))
    for words in held:
        if held[words]:
            yield done(words)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal runs, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    begins, stops = [0, *(b for _, b in runs)], [*(a for a, _ in runs), len(text)]
    return b"".join(text[a:b] for a, b in zip(begins, stops, strict=True))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, span: int = SPAN, passage: int | None = PASSAGE, passage_span: int = PASSAGE_SPAN) -> DataFrame:
    """(id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``has_passage``, ``runs``) of each row of ``docs``.

    Each byte goes that lies in a string of ``length`` bytes which also starts
    anywhere else, in the same text or another row's; all strings are those of
    the input.  ``runs`` are the maximal removed runs, (start, stop) in bytes.
    ``has_passage``: some ``passage`` words in a row (whatever blanks are between
    them) are in another row too; nothing goes for that.  ``passage=None``: null,
    and that search is left out.  A null text is empty; a text shorter than
    ``length`` loses nothing.  Repeated rows are copies: all their bytes go, if
    the text is long enough.  Rows with a null id are treated like any other.
    """
    facts = text_facts(docs, id_col, text_col)
    spans = repeated_spans(docs, facts, id_col=id_col, text_col=text_col, length=length, span=span, passage=passage, passage_span=passage_span)
    lost = spans.where(F.size("spans") > 0)
    chosen = _texts_of(docs, written(_one_each(facts, lost.select("key")), "cut-ids"), id_col, text_col).join(lost, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten()
            start, stop = (flat.field(k).to_numpy() for k in ("start", "stop"))
            at = batch.column(2).offsets.to_numpy()
            at = at - at[0]
            runs, digests = [], []
            for i in range(batch.num_rows):
                t = texts(batch.column(1).slice(i, 1))[0]
                own = merged(list(zip(start[at[i] : at[i + 1]].tolist(), stop[at[i] : at[i + 1]].tolist(), strict=True)))
                runs.append([{"start": a, "stop": b} for a, b in own])
                digests.append(hashlib.sha256(without(t, own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(digests, pa.string())], names=["key", "runs", "kept"])

    results = chosen.select("key", "text", "spans").mapInArrow(cut, "key binary, runs array<struct<start:long,stop:long>>, kept string")
    both = results.withColumn("has", F.lit(False)).unionByName(spans.where("has_passage").select("key", F.col("has_passage").alias("has")), allowMissingColumns=True)
    results = written(both.groupBy("key").agg(F.first("runs", True).alias("runs"), F.first("kept", True).alias("kept"), F.max("has").alias("has")), "cuts")
    removed = F.aggregate(F.coalesce("runs", F.array()), F.lit(0).cast("long"), lambda x, r: x + r["stop"] - r["start"])
    return facts.join(results, "key", "left").select(
        F.col("doc").alias(id_col), "n_bytes", removed.alias("n_removed"), F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"), (F.coalesce("has", F.lit(False)) if passage else F.lit(None).cast("boolean")).alias("has_passage"), "runs"
    )
