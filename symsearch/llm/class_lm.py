"""A class-based bigram model (Brown) of the corpus.

The chance of a text is the product over its tokens of the class's chance after
the class before it, and the word's chance in its class.  Exchange clustering
assigns the classes: a word moves to the class in which it raises the likelihood
of the training text most.

All counts are of all training documents:

1. tokens are counted by word, each task adding up its own first;
2. texts are written as numbers: those of the HEAD words (the most frequent ones,
   so many as a task can hold), and of all other words the bytes themselves;
3. the start: exchange on the driver over the WORD_UNITS most frequent words, and
   the other words by ending (a hash of their last two bytes); the number of these
   units is fixed, and each word begins in its unit's class;
4. ROUNDS of distributed exchange: of half of the head words each, the classes of
   their neighbours are counted, and each word goes where it fits best by the
   round's table of class pairs.  A round that lowers the likelihood is taken back,
   and is the last;
5. then every other word that occurs LEAST times or more goes where it fits best.
   Rarer ones, and words never seen, stay in the class of their ending.

Each move is by the exact gain of that word alone.  No table of words beyond the
head is ever in one task: the others join their counts and classes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symsearch.llm.common import LOWER, as_type, chunks, discard, texts, written

#: Production parameters: words sent to the tasks, words that start as units of their own, units of word endings, classes.
HEAD, WORD_UNITS, ENDINGS, CLASSES = 200_000, 1024, 255, 64
#: Rounds of exchange over the head words, and how often any other word has to occur to get a class by its neighbours.
ROUNDS, LEAST = 4, 2
#: A task hands on its counts when it has so many words.
FLUSH = 400_000
DELTA = 0.5


def tokens(text: bytes) -> list[bytes]:
    """The words of a text; the end token is left to the caller."""
    return text.translate(LOWER).split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def in_training(id_col: str, folds: int = 5, fold: int = 1) -> Column:
    """False for ids with that CRC-32 modulo ``folds``; true for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != fold, F.lit(True))


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all rows of ``docs``, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            all_texts = texts(batch.column(0))
            for a, b in chunks(all_texts):
                counts.update(tokens(b"\n".join(all_texts[a:b])))
                if len(counts) > FLUSH:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return written(parts.groupBy("word").agg(F.sum("n").alias("n")), "words")


def _counted(counts: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


@dataclass
class Head:
    """The frequent words: number and count of each."""

    numbers: dict[bytes, int]
    counts: np.ndarray  #: by number

    def number(self, words: list[bytes]) -> np.ndarray:
        get = self.numbers.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def line_table(docs: DataFrame, head, id_col: str, text_col: str, training: Column) -> DataFrame:
    """(row, doc, training, n, ids, at, rest) of each row of ``docs``: its tokens as numbers.

    ``ids``: 32 bits for each word, its number in the head or -1 less its ending;
    ``at`` and ``rest``: where the words beyond the head stand, and these words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            all_texts = texts(batch.column(2))
            for a, b in chunks(all_texts):
                own = [tokens(t) for t in all_texts[a:b]]
                words = [w for t in own for w in t]
                ids = head.value.number(words)
                beyond = np.flatnonzero(ids < 0)
                rest = [words[i] for i in beyond.tolist()]
                ids[beyond] = np.fromiter((-1 - ending(w) for w in rest), np.int64, len(rest))
                ends = np.cumsum([0] + [len(t) for t in own])
                lists = pa.array(np.searchsorted(beyond, ends).astype(np.int32))
                starts = np.repeat(ends[:-1], np.diff(ends))[beyond]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(b - a)),
                        *(batch.column(i).slice(a, b - a) for i in (0, 1)),
                        pa.array(np.diff(ends)),
                        _binaries(ids.astype("<i4"), ends),
                        pa.ListArray.from_arrays(lists, pa.array((beyond - starts).astype(np.int32))),
                        pa.ListArray.from_arrays(lists, pa.array(rest, pa.binary())),
                    ],
                    names=["row", "doc", "training", "n", "ids", "at", "rest"],
                )
                row += b - a

    schema = f"row long, doc {as_type(docs.schema, id_col)}, training boolean, n long, ids binary, at array<int>, rest array<binary>"
    return written(docs.select(F.col(id_col).alias("doc"), training.alias("training"), F.col(text_col).alias("text")).mapInArrow(run, schema), "lines")


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive values as the bytes of a binary each; ends: where each begins, and where the last one ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def by_id(head_values: np.ndarray, ending_values: np.ndarray) -> np.ndarray:
    """Values by the ids of :func:`line_table`: -1 is the first ending."""
    return np.concatenate((head_values, ending_values[::-1]))


def count_pairs(lines: DataFrame, of: np.ndarray, size: int, ids: str = "ids", kind: str = "<i4") -> np.ndarray:
    """How often a token of one unit (row) or class is followed by one of another (column); before the first token of a line is an end, 0.

    ``of``: the unit or class, below ``size``, of each id.
    """
    shared = lines.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            line = _with_ends(shared.value[_flat(batch.column(1), kind)], batch.column(0).to_numpy(), 0)
            total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    parts = lines.select("n", ids).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(size * size, np.int64)
    table = parts.toArrow()  # at most size * size rows
    out[table["pair"].to_numpy()] = table["n"].to_numpy()
    return out.reshape(size, size)


def _with_ends(values: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """An end before the first line, and after each."""
    ends = np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64) + 1)))
    out = np.full(len(values) + len(ends), end, np.int64)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = values
    return out


#: What follows a word is counted under the class, what is before it under CLASSES_MOST + the class; the word itself under TWICE.
CLASSES_MOST, TWICE = 127, 254


def _neighbours(names: np.ndarray, classes: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, code, n): what stands beside the chosen words of some lines; names tell words apart."""
    names, own = _with_ends(names, lengths, -(1 << 62)), _with_ends(classes, lengths, 0)
    at = np.flatnonzero(_with_ends(chosen, lengths, 0))
    before, after = names[at - 1] == names[at], names[at + 1] == names[at]
    codes = np.concatenate((np.where(before, TWICE, CLASSES_MOST + own[at - 1]), own[at + 1][~after]))
    keys, n = np.unique(np.concatenate((names[at], names[at][~after])) * 256 + codes, return_counts=True)
    return keys >> 8, keys & 255, n


def _packed(names: np.ndarray, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The distinct names, and the counts of each as 32-bit numbers: 24 bits of count, 8 of code."""
    start = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
    return names[start], _binaries((n << 8 | codes).astype("<u4"), np.append(start, len(names)))


def _tables(owner: np.ndarray, counts: np.ndarray, many: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, after, twice) of ``many`` words from packed counts and the word of each."""
    table = np.zeros((many, 256))
    np.add.at(table, (owner, counts & 255), counts >> 8)
    return table[:, CLASSES_MOST : CLASSES_MOST + classes], table[:, :classes], table[:, TWICE]


def head_moves(lines: DataFrame, of: np.ndarray, moving: np.ndarray, m: np.ndarray) -> dict[int, int]:
    """The new class of each head word of ``moving`` that has a better one than its own.

    ``of``: the class of each id; ``m``: the counts of class pairs.
    """
    shared = lines.sparkSession.sparkContext.broadcast((of, moving, m))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, moving, _ = shared.value
        for batch in batches:
            ids = _flat(batch.column(1), "<i4").astype(np.int64)
            names, counts = _packed(*_neighbours(ids, of[ids], batch.column(0).to_numpy(), (ids >= 0) & moving[ids]))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), counts], names=["word", "counts"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, _, m = shared.value
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:  # a task's words are some of the head, so their sums are bounded
            lengths = np.array([len(x) // 4 for x in batch.column(1).to_pylist()])
            counts = _flat(batch.column(1), "<u4").astype(np.int64)
            own = np.repeat(batch.column(0).to_numpy().astype(np.int64), lengths) * 256 + (counts & 255)
            keys, at = np.unique(np.concatenate((keys, own)), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate((sums, counts >> 8)), minlength=len(keys)).astype(np.int64)
        words, owner = np.unique(keys >> 8, return_inverse=True)
        for a in range(0, len(words), 2000):
            part = slice(*np.searchsorted(owner, (a, a + 2000)))
            some = words[a : a + 2000]
            new = best_classes(*_tables(owner[part] - a, sums[part] << 8 | keys[part] & 255, len(some), len(m)), of[some], m)
            moved = new != of[some]
            yield pa.RecordBatch.from_arrays([pa.array(some[moved].astype(np.int32)), pa.array(new[moved].astype(np.int32))], names=["word", "class"])

    counted = lines.select("n", "ids").mapInArrow(count, "word int, counts binary")
    table = counted.repartition("word").mapInArrow(move, "word int, class int").toArrow()  # words of the head
    return dict(zip(table["word"].to_pylist(), table["class"].to_pylist(), strict=True))


def rest_classes(lines: DataFrame, of: np.ndarray, m: np.ndarray, least: int = LEAST) -> DataFrame:
    """(word, n, class) of the words beyond the head."""
    shared = lines.sparkSession.sparkContext.broadcast((of, m))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, _ = shared.value
        for batch in batches:
            ids = _flat(batch.column(1), "<i4").astype(np.int64)
            words = batch.column(2).flatten().dictionary_encode()
            names, rest = ids.copy(), ids < 0
            names[rest] = -1 - words.indices.to_numpy()
            own, counts = _packed(*_neighbours(names, of[ids], batch.column(0).to_numpy(), rest))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(-1 - own)), counts], names=["word", "counts"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, m = shared.value
        held: list[tuple[bytes, bytes]] = []

        def done(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            words = list(dict.fromkeys(w for w, _ in rows))
            place = {w: i for i, w in enumerate(words)}
            owner = np.repeat([place[w] for w, _ in rows], [len(c) // 4 for _, c in rows])
            before, after, twice = _tables(owner, np.frombuffer(b"".join(c for _, c in rows), "<u4").astype(np.int64), len(words), len(m))
            n = before.sum(1) + twice
            old = of[[-1 - ending(w) for w in words]]
            new, some = old.copy(), n >= least
            new[some] = best_classes(before[some], after[some], twice[some], old[some], m)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n.astype(np.int64)), pa.array(new.astype(np.int32))], names=["word", "n", "class"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(held) >= 4000 and row[0] != held[-1][0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    counted = lines.select("n", "ids", "rest").mapInArrow(count, "word binary, counts binary")
    return written(counted.repartition("word").sortWithinPartitions("word").mapInArrow(move, "word binary, n long, class int"), "rest-words")


def best_classes(before: np.ndarray, after: np.ndarray, twice: np.ndarray, old: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The class in which each word raises the likelihood most, its own one if none is better; each by itself.

    ``before`` and ``after``: how often each class stands beside each word;
    ``twice``: how often the word follows itself; ``old``: the classes that the
    words are counted under in ``m``.  The end's class, 0, takes no word.
    """
    out = np.empty(len(old), np.int64)
    for a in range(0, len(old), 500):
        out[a : a + 500] = _best_classes(before[a : a + 500], after[a : a + 500], twice[a : a + 500], old[a : a + 500], m)
    return out


def _best_classes(before: np.ndarray, after: np.ndarray, twice: np.ndarray, old: np.ndarray, m: np.ndarray) -> np.ndarray:
    m = m.astype(float)
    here = np.eye(len(m), dtype=bool)[old]
    gain = np.zeros(here.shape)
    # of the pairs with each neighbour's class, without the word in its old class and with it in each
    for beside, other, pairs in ((after, before, m.T), (before, after, m)):
        word, j = np.nonzero(beside)
        k = beside[word, j][:, None]
        own = (j == old[word])[:, None]
        base = pairs[j] - here[word] * k - own * other[word] - (here[word] & own) * twice[word][:, None]
        terms = _xlogx(base + k) - _xlogx(base)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else word
        gain[word[first]] += np.add.reduceat(terms, first) if len(first) else 0
    both, t = before + after, twice[:, None]
    d = np.diag(m) - here * (both + t)
    gain += _xlogx(d + both + t) - _xlogx(d + after) - _xlogx(d + before) + _xlogx(d)
    for beside, sums in ((after, m.sum(1)), (before, m.sum(0))):
        k = beside.sum(1)[:, None] + t
        base = sums - here * k
        gain -= _xlogx(base + k) - _xlogx(base)
    gain[:, 0] = -np.inf
    new = gain.argmax(1)
    # what rounding can't feign
    better = gain[np.arange(len(old)), new] > gain[np.arange(len(old)), old] + 1e-9 + 1e-13 * float(_xlogx(m.sum()))
    return np.where(better, new, old)


def likelihood(m: np.ndarray) -> float:
    """Of the classes' pairs; the words' share doesn't depend on the classes."""
    m = m.astype(float)
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int | None = None) -> np.ndarray:
    """A class for each unit; the end token alone has class 0.

    Starts from ranks by frequency, dealt in turn, and moves each unit to the
    class with the highest likelihood until a round moves none (or for
    ``rounds``).  Each move raises the likelihood, so it ends.
    """
    size = len(pairs)
    b = pairs.astype(float)
    weight = b.sum(0) + b.sum(1)
    order = [u for u in np.argsort(-weight, kind="stable").tolist() if u and weight[u]]
    of = np.full(size, 1 if classes > 1 else 0)
    of[0] = 0
    free = max(1, classes - 1)
    for i, u in enumerate(order):
        of[u] = 1 + i % free if classes > 1 else 0
    onehot = np.eye(classes)[of]
    m = onehot.T @ b @ onehot
    left_of, right_of = onehot.T @ b, b @ onehot  # of each unit: what its classes of neighbours before and after it count
    least = 1e-9 + 1e-13 * float(_xlogx(b.sum()))  # what rounding can't feign
    moved, done = classes > 2, 0
    while moved and (rounds is None or done < rounds):
        moved, done = 0, done + 1
        for u in order:
            old, self_ = of[u], b[u, u]
            before, after = left_of[:, u].copy(), right_of[u].copy()
            before[old] -= self_
            after[old] -= self_
            m[old] -= after
            m[:, old] -= before
            m[old, old] -= self_
            rows, columns = m.sum(1) + before, m.sum(0) + after  # with the unit's neighbours, wherever it goes
            fm = _xlogx(m)
            diagonal = np.diag(m)
            gain = (_xlogx(m + after) - fm).sum(1) + (_xlogx(m + before[:, None]) - fm).sum(0)
            gain += _xlogx(diagonal + before + after + self_) - _xlogx(diagonal + after) - _xlogx(diagonal + before) + np.diag(fm)
            gain -= _xlogx(rows + after.sum() + self_) - _xlogx(rows) + _xlogx(columns + before.sum() + self_) - _xlogx(columns)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + least:
                new = old
            m[new] += after
            m[:, new] += before
            m[new, new] += self_
            if new != old:
                moved += 1
                of[u] = new
                left_of[old] -= b[u]
                left_of[new] += b[u]
                right_of[:, old] -= b[:, u]
                right_of[:, new] += b[:, u]
    return of


@dataclass
class ClassModel:
    head: Head
    rest: DataFrame  #: (word, n, class) of the training words beyond the head
    lines: DataFrame  #: :func:`line_table` of all rows that it was given
    docs: DataFrame
    tokens: int  #: in training, ends included
    distinct: int  #: in training, the end token included
    documents: int
    classes: np.ndarray  #: by id: of the head's words, and of the endings
    in_class: np.ndarray  #: training tokens of each class
    kinds: np.ndarray  #: distinct training words of each class
    likelihoods: list[float]  #: before each round of exchange, and after the last one


def fit(docs: DataFrame, *, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, head: int = HEAD, rounds: int = ROUNDS, least: int = LEAST) -> ClassModel:
    """Learn from the rows of ``docs`` for which ``training`` is true (None: all); a null text is empty, that is, one end token.

    ``classes``: 127 at most.  A table without training rows gives a model that
    knows no word.
    """
    training = F.lit(True) if training is None else training
    words = count_words(docs.where(training), text_col)
    distinct, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # words by the size of their counts, in some ten thousand steps: the topmost steps that hold at most ``head`` words
    step = F.floor(F.log("n") * 1000)
    least_step, many = None, 0
    for at, k in words.groupBy(step.alias("s")).agg(F.count(F.lit(1))).orderBy(F.desc("s")).collect():
        if (many := many + k) > head:
            break
        least_step = at
    top = words.where(step >= least_step if least_step is not None else F.lit(False)).toArrow()
    discard(words)
    order = sorted(zip(top["n"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    known = Head({w: i for i, (_, w) in enumerate(order)}, np.array([n for n, _ in order], np.int64))
    lines = line_table(docs, docs.sparkSession.sparkContext.broadcast(known), id_col, text_col, training)
    learned = lines.where("training")
    # the start, by units
    units = np.array([1 + i if i < WORD_UNITS else 1 + WORD_UNITS + ending(w) for i, (_, w) in enumerate(order)], np.int64)
    units = by_id(units, 1 + WORD_UNITS + np.arange(ENDINGS))
    of = exchange(count_pairs(learned, units, 1 + WORD_UNITS + ENDINGS), classes)[units]
    # rounds over the head: its odd and even words (by a hash) in turn
    odd = np.array([zlib.crc32(w) & 1 for _, w in order], bool)
    m, steps = count_pairs(learned, of, classes), []
    steps.append(likelihood(m))
    for r in range(rounds if classes > 2 else 0):
        new = of.copy()
        for word, c in head_moves(learned, of, by_id(odd == bool(r % 2), np.zeros(ENDINGS, bool)), m).items():
            new[word] = c
        new_m = count_pairs(learned, new, classes)
        if likelihood(new_m) <= steps[-1]:
            break
        of, m = new, new_m
        steps.append(likelihood(m))
    rest = rest_classes(learned, of, m, least if classes > 2 else 1 << 62)
    documents = learned.count()
    in_class = np.bincount(of[: len(order)], weights=known.counts, minlength=classes)
    kinds = np.bincount(of[: len(order)], minlength=classes).astype(float)
    in_class[0] += documents
    for c, k, n in rest.groupBy("class").agg(F.count(F.lit(1)), F.sum("n")).collect():
        in_class[c] += n
        kinds[c] += k
    return ClassModel(known, rest, lines, docs, total + documents, distinct + (documents > 0), documents, of, in_class, kinds, steps)


def transitions(m: np.ndarray, in_class: np.ndarray) -> np.ndarray:
    """log10 of a class's chance (column) after a class (row), smoothed with the classes' own chances by how many classes follow."""
    prior = (in_class + 0.5) / (in_class.sum() + 0.5 * len(m))
    seen, follow = m.sum(1), (m > 0).sum(1)
    weight = np.where(seen > 0, follow, 1)
    return np.log10((m + weight[:, None] * prior) / (seen + weight)[:, None])


def resolved_lines(model: ClassModel, lines: DataFrame) -> DataFrame:
    """(doc, training, n, classes, n_known, base, emitted) of each line: a byte for each word's class, and sums over its words."""
    n, v, counts, in_class, kinds = model.tokens, model.distinct, model.head.counts, model.in_class, model.kinds
    base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    emit_of = lambda c, k: np.log10((c + DELTA) / (in_class[k] + DELTA * (kinds[k] + 1)))
    zeros = np.zeros(ENDINGS)
    base, emit = by_id(base_of(counts), zeros), by_id(emit_of(counts, model.classes[: len(counts)]), zeros)
    shared = lines.sparkSession.sparkContext.broadcast((model.classes, base, emit, by_id(np.ones(len(counts)), zeros)))
    doc = as_type(lines.schema, "doc")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, *values = shared.value
        for batch in batches:
            ids, lengths = _flat(batch.column(4), "<i4"), batch.column(3).to_numpy()
            ends = np.concatenate(([0], np.cumsum(lengths)))
            add = lambda x, ends=ends: np.diff(np.concatenate(([0.0], np.cumsum(x)))[ends])
            sums = [add(x[ids]) for x in values]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), _binaries(classes[ids].astype(np.uint8), ends), pa.array(np.rint(sums[2]).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])], names=["row", "doc", "training", "n", "classes", "n_known", "base", "emitted"])

    parts = lines.select("row", "doc", "training", "n", "ids").mapInArrow(known, f"row long, doc {doc}, training boolean, n long, classes binary, n_known long, base double, emitted double")
    # the words beyond the head join their counts and classes, and come back to their lines
    each = lines.select("row", F.explode(F.arrays_zip("at", "rest")).alias("x")).select("row", "x.at", F.col("x.rest").alias("word"))
    found = each.join(model.rest, "word", "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(-1)).alias("class")))).alias("found"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, lengths = _flat(batch.column(3), "u1").astype(np.int64), batch.column(2).to_numpy()
            ends = np.concatenate(([0], np.cumsum(lengths)))
            lists = batch.column(7)
            many = np.diff(np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))))
            owner = np.repeat(np.arange(len(lengths)), many)
            flat = lists.flatten()
            at, c, k = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("at", "n", "class"))
            place = ends[owner] + at
            k = np.where(k < 0, classes[place], k)  # words of no training text: the class of their ending
            classes[place] = k
            add = lambda x, owner=owner, size=len(lengths): np.bincount(owner, weights=x, minlength=size)
            sums = [batch.column(4).to_numpy() + np.rint(add(c > 0)).astype(np.int64), batch.column(5).to_numpy() + add(base_of(c)), batch.column(6).to_numpy() + add(emit_of(c, k))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binaries(classes.astype(np.uint8), ends), *map(pa.array, sums)], names=["doc", "training", "n", "classes", "n_known", "base", "emitted"])

    both = parts.join(found, "row", "left").select("doc", "training", "n", "classes", "n_known", "base", "emitted", "found")
    return written(both.mapInArrow(fill, f"doc {doc}, training boolean, n long, classes binary, n_known long, base double, emitted double"), "resolved")


def score(model: ClassModel, docs: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``) of each row that the model was given, or of each of ``docs``.

    ``base_score`` is the unigram log10 probability with additive smoothing and
    ``score`` the model's.  A null text is an empty one: an end token alone.
    Repeated rows are scored alike; a null id stays null; other columns are not
    read.  A model of no documents gives all tokens the same chance.
    """
    size = len(model.in_class)
    own = resolved_lines(model, model.lines)
    after = transitions(count_pairs(own.where("training"), np.arange(size), size, "classes", "u1"), model.in_class)
    if docs is not None:
        head = docs.sparkSession.sparkContext.broadcast(model.head)
        own = resolved_lines(model, line_table(docs, head, id_col, text_col, F.lit(False)))
    n, v, known_end = model.tokens, model.distinct, int(model.documents > 0)
    end_base = float(np.log10((model.documents + 0.5) / (n + 0.5 * (v + 1))))
    shared = own.sparkSession.sparkContext.broadcast(after)

    def add_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            line = _with_ends(_flat(batch.column(2), "u1"), lengths, 0)
            steps = np.concatenate(([0.0], np.cumsum(shared.value[line[:-1], line[1:]])))
            steps = np.diff(steps[np.concatenate(([0], np.cumsum(lengths + 1)))])
            sums = [lengths + 1, batch.column(3).to_numpy() + known_end, np.full(len(lengths), n), batch.column(4).to_numpy() + end_base, batch.column(5).to_numpy() + steps]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=["doc", *names])

    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    scored = own.select("doc", "n", "classes", "n_known", "base", "emitted").mapInArrow(add_steps, f"doc {as_type(own.schema, 'doc')}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(F.col("doc").alias(id_col), *names, F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
