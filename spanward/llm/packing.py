"""Harmonic packing of token ids into sequences, independently per worker.

A length in (C / (k + 1), C / k] belongs to class k, and a bin of class k is full with k pieces of it. Since documents
may be cut, a rest is cut at floor(C / k) for the least k that gives a piece, again and again, until at most ``SMALL``
ids are left: all but the smallest classes then hold pieces of one length and their bins are full to a few ids. Each
task fills its own bins and keeps one open bin per class. What is left in open bins at its end, a few hundred pieces
however long the task, goes to a second step, where the tails of ``TAIL_PARTS`` tasks are laid end to end and cut at
the capacity.

Ids are those of the tokenizer over the whole text. This tokenizer never joins certain neighbours, such as words on both
sides of white space, so equal words are encoded once per task and texts are put together from them.

Defined cases: null or empty text is the end id alone; repeated rows are documents of their own; null ids are kept; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from .arrow import flat, row_slices, strings, word_bounds

CAPACITY = 4096
END_ID = 2
#: A rest of at most so many ids is not cut any more.
SMALL = 64
#: Tasks whose open bins are packed together.
TAIL_PARTS = 32
#: Words that a task remembers before it starts anew.
MEMORY_WORDS = 1 << 18
#: Text encoded at once.
ENCODE_BYTES = 2 << 20
# Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 punctuation, 4 anything else.
_KIND = np.full(256, 4, np.uint8)
_KIND[[9, 10, 13, 32]] = 0
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = 3
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, part int"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of texts that the tokenizer never joins; first part of each text.

    It never joins across white space, nor a letter, digit or punctuation mark with one of another of these kinds.
    Quotes, angle brackets and bars (of contractions and special tokens) and all but Latin-1 letters stay with their
    neighbours.
    """
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    member = kind > 0
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    if len(data):
        fresh[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] < 4) & (kind[:-1] < 4)
    starts = np.flatnonzero(member & fresh[:-1] | member & ~np.concatenate([[False], member[:-1]]))
    ends = np.flatnonzero(member & fresh[1:] | member & ~np.concatenate([member[1:], [False]])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _lowered(data: np.ndarray) -> np.ndarray:
    """ASCII in lower case, where that cannot matter: fewer words differ then.

    Special tokens are written in lower case, so nothing changes where one could be meant; a letter in front of a
    combining mark is composed with it first.
    """
    if b"<|" in data.tobytes():
        return data
    after = np.append(data[1:], np.uint8(32))
    return np.where((after < 0x80) | (after == 0xC3), _LOWERED[data], data)


class WordIds:
    """Ids of texts of one Arrow column, put together from the ids of their words."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.place), len(words)
        while n + m > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + m] = sizes
        self.place.update(zip(words, range(n, n + m)))
        self.used += len(ids)

    def _learn(self, words: list[str]) -> None:
        """Words of letters give one run of ids each, ended by a word-end id, so they are encoded in one text."""
        plain = [w for w in words if w.isalpha()]
        if plain:
            ids = np.array(self._ids([" ".join(plain)])[0], np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain):
                self._keep(plain, ids, np.diff(ends, prepend=0))
        rest = [w for w in words if w not in self.place]
        if rest:
            found = self._ids(rest)
            self._keep(rest, np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text begins."""
        data, offsets = flat(column)
        starts, ends, first = _word_places(data, offsets)
        lower = _lowered(data)
        coded = strings(lower, starts, ends).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.place) + len(words) > MEMORY_WORDS:
            self.clear()
        fresh = [w for w in words if w not in self.place]
        if fresh:
            self._learn(fresh)
        place = np.array([self.place[w] for w in words], np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        sizes = self.sizes[place]
        before = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        take = np.repeat(self.starts[place] - before[:-1], sizes)
        take += np.arange(before[-1])
        return self.ids[take], before[first]


def cut_lengths(n: int, capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    while rest > small:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    if rest:
        out.append(rest)
    return out


class _Rows:
    """Rows of pieces, given out as Arrow batches."""

    def __init__(self, keep_ids: bool):
        self.keep, self.rows = keep_ids, []

    def add(self, piece, sequence: int | None, offset: int | None, part: int, keep: bool = False) -> None:
        doc, start, ids, crc, total = piece
        self.rows.append((doc, start, len(ids), crc, total, sequence, offset, ids.tobytes() if keep or self.keep else None, part))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary(), pa.int32()]
        names = [c.split()[0] for c in PIECE.split(", ")]
        columns = list(zip(*self.rows)) or [[]] * 9
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _piece(doc, start: int, ids: np.ndarray, total: int):
    return doc, start, ids, zlib.crc32(ids), total


def pack_task(path: str, capacity: int, end_id: int, keep_ids: bool):
    """Fill bins by class within one task; rows without a sequence are its open bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder, rows, bins, made = WordIds(path), _Rows(keep_ids), {}, 0
        for batch in row_slices(batches, "text", ENCODE_BYTES):
            ids, first = coder.encode(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                at = 0
                for n in cut_lengths(len(own), capacity):
                    k = capacity // n
                    open_bin = bins.setdefault(k, [])
                    open_bin.append(_piece(doc, at, own[at : at + n], len(own)))
                    at += n
                    if len(open_bin) == k:
                        place = 0
                        for piece in open_bin:
                            rows.add(piece, (part << 32) + made, place, part)
                            place += len(piece[2])
                        made += 1
                        bins[k] = []
            if len(rows.rows) > 20_000 or (keep_ids and len(rows.rows) > 2_000):
                yield rows.batch()
        for k in sorted(bins):
            for piece in bins[k]:
                rows.add(piece, None, None, part, keep=True)
        yield rows.batch()

    return run


def _tails(capacity: int, keep_ids: bool):
    """Lay open pieces end to end and cut them where a sequence is full."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = [("part", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]
        rows, sequence, used = _Rows(keep_ids), (1 << 62) + (key[0].as_py() << 32), 0
        for r in table.sort_by(order).to_pylist():
            ids, at = np.frombuffer(r["ids"], "<u4"), 0
            while at < len(ids):
                n = min(len(ids) - at, capacity - used)
                rows.add(_piece(r["doc_id"], r["start"] + at, ids[at : at + n], r["doc_tokens"]), sequence, used, r["part"])
                at, used = at + n, used + n
                if used == capacity:
                    sequence, used = sequence + 1, 0
        return pa.Table.from_batches([rows.batch()])

    return run


def harmonic_pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, on request).

    ``tokenizer`` is the path of a tokenizer file that every node has.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    packed = materialise(rows.mapInArrow(pack_task(tokenizer, capacity, end_id, keep_ids), PIECE), "packed")
    open_bins = packed.where(F.col("sequence_id").isNull()).groupBy(F.expr(f"part div {TAIL_PARTS}"))
    tails = open_bins.applyInArrow(_tails(capacity, keep_ids), PIECE)
    out = packed.where(F.col("sequence_id").isNotNull()).unionByName(tails).drop("part")
    return out if keep_ids else out.drop("ids")
