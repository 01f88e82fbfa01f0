"""Packing by concatenating and cutting.

All token sequences are thought of as one stream, cut into windows of equal
length.  A first pass tokenizes, writes the ids to the shared folder and records
each document's place within its partition.  The partitions' token totals are
summed up to prefix sums, one number a partition, so the second pass knows the
global offset of every document without a shuffle.  It cuts each document at the
window boundaries; a window over a partition's end is simply named by pieces
(boundary records) of both partitions.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symsearch.llm.common import LOWER, as_type, chunks, texts, written

LENGTH, END = 4096, 2
#: Of so many words, about, a worker remembers the ids in each of two generations.
WORDS_KEPT = 200_000
#: A run of these after a letter or digit is a token group of its own.
_SIGNS = b".,;:!?%*&$#|"


def _ends_with_letter(stem: bytes) -> bool:
    return bool(stem) and (stem[-1:].isalnum() or stem[-1] > 127 and stem[-4:].decode("utf-8", "ignore")[-1:].lower()[-1:].isalpha())


#: Words of Latin letters in lower case: no normalizer changes them and no pre-tokenizer parts them.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+")
#: Stands for the end of a word; no UTF-8 text has this byte.
_WORD_END = b"\xff"


def _bpe_core(path: str):
    """The file's merges in a faster core for words of _PLAIN, and the ids of the core's ranks; (None, []) if the file isn't of that kind.

    The core merges by the rank of the outcome.  Each token is the outcome of
    one merge, so that is the file's order; an end joins the last byte first.
    The tests compare both on many words.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
        return None, []
    # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and up
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranks: dict[bytes, int] = {}
    ids: list[int] = []
    for t in [*(c + "</w>" for c in byte_of), *byte_of, *merged]:
        raw = bytes(byte_of[c] for c in t.removesuffix("</w>")) + _WORD_END * t.endswith("</w>")
        if raw in ranks or t not in model["vocab"]:
            return None, []
        ranks[raw] = len(ids)
        ids.append(model["vocab"][t])
    ranks[_WORD_END] = len(ids)
    return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe, ids


class WordTokenizer:
    """Ids of a tokenizer that lower-cases and never joins letters with signs, or what ASCII white space parts.

    Each word is tokenized once and remembered; the signs after a word are
    tokenized on their own.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.fast, self.fast_ids = _bpe_core(path)
        self.young, self.old = _Words(self), _Words(self)

    def encode(self, texts_: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian bytes.

        Words that have not been met for a while are forgotten: a full
        generation becomes the old one, and what is used again gets young.
        """
        if len(self.young) > WORDS_KEPT:
            self.young, self.old = _Words(self), self.young
        look = self.young.__getitem__
        # the tokenizer lower-cases too, but looks for its special tokens before that
        return [b"".join(map(look, (t if b"<|" in t else t.translate(LOWER)).split())) for t in texts_]

    def learn(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is not None:
            return ids
        if self.fast and _PLAIN.fullmatch(word):
            return array(self.kind, map(self.fast_ids.__getitem__, self.fast.encode_single_piece(word + _WORD_END))).tobytes()
        if len(stem := word.rstrip(_SIGNS)) < len(word) and _ends_with_letter(stem):
            return self.young[stem] + self.young[word[len(stem) :]]
        return array(self.kind, self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()


class _Words(dict):
    """Ids by word; a word that isn't known is learnt when it is looked up."""

    def __init__(self, tokenizer_: WordTokenizer) -> None:
        self.learn = tokenizer_.learn

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = self.learn(word)
        return ids


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker and file."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenized(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int | None = END) -> DataFrame:
    """(doc, part, before, n, ids) of each row: its partition, the tokens before it there, its number of tokens, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = tokenizer(path), TaskContext.get().partitionId(), 0
        tail = b"" if end is None else np.array([end], coder.dtype).tobytes()
        for batch in batches:
            all_texts = texts(batch.column(1))
            for a, b in chunks(all_texts, 4 << 20):
                ids = [x + tail for x in coder.encode(all_texts[a:b])]
                n = np.array([len(x) // coder.dtype.itemsize for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([part] * len(n), pa.int32()), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc", "part", "before", "n", "ids"],
                )
                before += int(n.sum())

    schema = f"doc {as_type(docs.schema, id_col)}, part int, before long, n long, ids binary"
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int | None = END) -> DataFrame:
    """The pieces of all documents: id, ``start``, ``length``, ``ids`` (binary: little-endian, 32 bits each), ``doc_tokens``, ``sequence_id``, ``offset``.

    A null or empty text is its end token alone (no piece, if ``end`` is None).
    Repeated rows, and rows with a null id, are packed like any other.  Other
    columns are not read.  Every sequence but the last has ``length`` tokens.
    """
    coded = written(tokenized(docs, path, id_col=id_col, text_col=text_col, end=end), "tokens")
    width = tokenizer(path).dtype
    # one number a partition
    totals = {r.part: r.n for r in coded.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    parts = sorted(totals)
    begins = dict(zip(parts, np.cumsum([0, *(totals[p] for p in parts)])[:-1].tolist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, part, before, n, raw = batch.columns
            begin = np.array([shared.value[p] for p in part.to_pylist()], np.int64) + before.to_numpy()
            n, raw = n.to_numpy(), raw.to_pylist()
            for a, b in chunks(raw):
                # the windows that a document begins and ends in
                first, last = begin[a:b] // length, (begin[a:b] + np.maximum(n[a:b], 1) - 1) // length
                pieces = np.where(n[a:b] > 0, last - first + 1, 0)
                row = np.repeat(np.arange(b - a), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = first[row] + nth
                start = np.maximum(sequence * length, begin[a:b][row]) - begin[a:b][row]
                stop = np.minimum((sequence + 1) * length - begin[a:b][row], n[a:b][row])
                wide = {r: np.frombuffer(raw[a + r], width).astype("<u4").tobytes() for r in set(row.tolist())}
                ids = [wide[r][4 * s : 4 * e] for r, s, e in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), *map(pa.array, (start, stop - start)), pa.array(ids, pa.binary()), *map(pa.array, (n[a:b][row], sequence, begin[a:b][row] + start - sequence * length))],
                    names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return coded.mapInArrow(run, f"{id_col} {as_type(docs.schema, id_col)}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, *, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(``sequence_id``, ``n_tokens``, ``ids``) of each window: its pieces put together.

    A shorter sequence is padded to ``length``, except at a power of two.  No
    pieces give no sequences; an end token alone is a piece, so documents without
    text are in them too.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    put = pieces.groupBy("sequence_id").agg(ordered.alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    ids = F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    one = F.unhex(F.lit(np.array([pad], "<u4").tobytes().hex()))
    whole = (F.bit_count("n_tokens") == 1) | (F.col("n_tokens") >= length)
    padding = F.when(whole, F.unhex(F.lit(""))).otherwise(F.unhex(F.repeat(F.hex(one), (F.lit(length) - F.col("n_tokens")).cast("int"))))
    return put.select("sequence_id", n.alias("n_tokens"), ids.alias("ids")).select("sequence_id", "n_tokens", F.concat("ids", padding).alias("ids"))
