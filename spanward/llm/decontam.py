"""Benchmark passages in documents by a positional inverted index.

Documents are indexed in segments of a few megabytes, each one row: a sorted term dictionary and, term by term, the
positions of its words. A segment can be searched alone, so the index is spread like the documents and no posting
list, of however common a word, meets in one task. It is written once and serves any number of benchmarks.

A search takes windows of consecutive item words in bounded chunks. In every segment a window whose terms are not all
there is dropped; the positions of its rarest term, less the term's place in the window, are the candidates, and the
offset-adjusted lists of the other terms are intersected with them from rare to common. ``near`` asks only that all
terms stand within some words of each other.

Words are compared by 64-bit hashes of their bytes; a false phrase needs such a collision at nine other equal words.

Defined cases: null or empty text has no words and no hits; items with null id take no part, items without words have
no window, items that share an id are one item; repeated rows are documents of their own; an empty benchmark gives no
hits; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from .arrow import LOWER_VALUE, Prefix, U, binary, flat, row_slices, word_bounds

WINDOW = 10
#: Windows searched in one pass over the index; the chunk travels to every task (about 16 MB).
CHUNK_WINDOWS = 150_000
#: Text of one index segment.
SEGMENT_BYTES = 2 << 20
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

SEGMENT = "segment bigint, doc_ids array<bigint>, first binary, terms binary, term_first binary, steps binary"
FOUND = "segment bigint, slot int, doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def _hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(column)
    starts, ends, first = word_bounds(data, offsets, _WORD)
    return Prefix(data, LOWER_VALUE).hashes(starts, ends), first


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = TaskContext.get().partitionId() << 32
    for batch in row_slices(batches, "text", SEGMENT_BYTES):
        words, first = _hashed_words(batch.column(1))
        order = np.argsort(words)
        ordered = words[order]
        fresh = np.ones(len(ordered), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.cumsum(fresh) - 1
        places = np.sort((rank.astype(U) << U(32)) | order.astype(U)) & U(0xFFFFFFFF)
        at = np.flatnonzero(fresh)
        steps = np.diff(places.astype(np.int64), prepend=0).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([made], pa.int64()),
                pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([binary(first.astype(np.int32))], pa.binary()),
                pa.array([binary(ordered[at])], pa.binary()),
                pa.array([binary(np.append(at, len(words)).astype(np.int32))], pa.binary()),
                pa.array([binary(steps)], pa.binary()),
            ],
            [c.split()[0] for c in SEGMENT.split(", ")],
        )
        made += 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs``, written to the shared folder."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(_segments, SEGMENT), "word-index")


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            words, first = _hashed_words(batch.column(1))
            items, sizes, terms = [], [], []
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = words[first[i] : first[i + 1]]
                n = min(width, len(own))
                for at in range(len(own) - n + 1 if n else 0):
                    items.append(item)
                    sizes.append(n)
                    terms.append(binary(own[at : at + n]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(sizes, pa.int32()), pa.array(terms, pa.binary())], ["item", "size", "terms"])

    return run


def windows_of(items: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, terms) of every window of ``items``; equal windows of an item once."""
    ship(items.sparkSession)
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL")
    return rows.mapInArrow(_windows(width), "item string, size int, terms binary").distinct()


class Segment:
    """One segment, ready to be searched."""

    def __init__(self, row: dict):
        self.docs = row["doc_ids"]
        self.first = np.frombuffer(row["first"], np.int32)
        self.terms = np.frombuffer(row["terms"], U)
        self.term_first = np.frombuffer(row["term_first"], np.int32)
        places = np.cumsum(np.frombuffer(row["steps"], np.int32), dtype=np.int64)
        ranks = np.repeat(np.arange(len(self.terms)), np.diff(self.term_first))
        self.places, self.postings = places, (ranks << 32) | places

    def lookup(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of postings of terms, 0 for those that are not there."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        rank = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        size = np.where(self.terms[rank] == terms, self.term_first[rank + 1].astype(np.int64) - self.term_first[rank], 0)
        return rank, size

    def holds(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a term has a posting at a place."""
        key = (rank << 32) | np.maximum(place, 0)
        at = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
        return (self.postings[at] == key) & (place >= 0)

    def close(self, rank: np.ndarray, place: np.ndarray, reach: int) -> np.ndarray:
        """Whether a term has a posting less than ``reach`` words from a place."""
        at = np.searchsorted(self.postings, (rank << 32) | np.maximum(place - reach + 1, 0))
        at = np.minimum(at, len(self.postings) - 1)
        return (self.postings[at] >> 32 == rank) & (self.postings[at] <= ((rank << 32) | (place + reach - 1)))

    def search(self, terms: np.ndarray, sizes: np.ndarray, near: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of all matches: first words of phrases, or rarest words of near matches."""
        width = terms.shape[1]
        inside = np.arange(width) < sizes[:, None]
        rank, count = self.lookup(terms)
        alive = np.flatnonzero(((count > 0) | ~inside).all(axis=1))
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(np.where(inside[alive], count[alive], np.iinfo(np.int64).max), axis=1, kind="stable")
        lead = order[:, 0]
        lists, begin = count[alive, lead], self.term_first[rank[alive, lead]]
        which = np.repeat(np.arange(len(alive)), lists)
        within = np.arange(len(which)) - np.repeat(np.cumsum(lists) - lists, lists)
        place = self.places[np.repeat(begin, lists) + within] - (0 if near else lead[which])
        for k in range(1, width):
            column = order[which, k]
            asked = column < sizes[alive[which]]
            term = rank[alive[which], column]
            ok = self.close(term, place, near) if near else self.holds(term, place + column)
            stay = ok | ~asked
            which, place = which[stay], place[stay]
        window = alive[which]
        length = np.where(near, 1, sizes[window])
        doc = np.searchsorted(self.first, place, "right") - 1
        whole = place + length <= self.first[np.minimum(doc + 1, len(self.first) - 1)]
        return window[whole], place[whole]


def _search(chunk, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, item, sizes, terms = chunk.value
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row)
                window, place = segment.search(terms, sizes, near)
                n_words, n_docs = int(segment.first[-1]), len(segment.docs)
                ends = place + (1 if near else sizes[window])
                depth = np.zeros(n_words + 1, np.int64)
                np.add.at(depth, place, 1)
                np.add.at(depth, ends, -1)
                hit = np.cumsum(depth)[:n_words] > 0
                doc = np.searchsorted(segment.first, place, "right") - 1
                pairs = np.unique((doc << 32) | item[window])
                by_doc = np.searchsorted(pairs, np.arange(n_docs + 1) << 32)
                edge = np.zeros(n_words + 1, bool)
                edge[segment.first] = True
                start = hit & np.concatenate([[True], ~hit[:-1]] if n_words else [[]]).astype(bool)
                start |= hit & edge[:n_words]
                end = hit & np.concatenate([~hit[1:], [True]] if n_words else [[]]).astype(bool)
                end |= hit & edge[1:]
                a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
                runs = np.searchsorted(a, segment.first)
                spans = []
                for i in range(n_docs):
                    base = int(segment.first[i])
                    spans.append([{"start": int(x) - base, "end": int(y) - base} for x, y in zip(a[runs[i] : runs[i + 1]], b[runs[i] : runs[i + 1]])])
                found = [[names[p & 0xFFFFFFFF] for p in pairs[by_doc[i] : by_doc[i + 1]]] for i in range(n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * n_docs, pa.int64()),
                        pa.array(range(n_docs), pa.int32()),
                        pa.array(segment.docs, pa.int64()),
                        pa.array(np.diff(segment.first).astype(np.int64), pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(found, pa.list_(pa.string())),
                    ],
                    ["segment", "slot", "doc_id", "n_words", "spans", "items"],
                )

    return run


def _chunk(rows: list) -> tuple:
    names = sorted({r["item"] for r in rows})
    number = {n: i for i, n in enumerate(names)}
    width = max((r["size"] for r in rows), default=1)
    terms = np.zeros((len(rows), width), U)
    for i, r in enumerate(rows):
        terms[i, : r["size"]] = np.frombuffer(r["terms"], U)
    return names, np.array([number[r["item"]] for r in rows], np.int64), np.array([r["size"] for r in rows], np.int64), terms


def find_windows(index: DataFrame, windows: DataFrame, near: int = 0) -> DataFrame:
    """One row per indexed document: segment, slot, doc_id, n_words, spans (hit word runs), items.

    ``near`` over 0 asks for all terms less than so many words from the rarest one instead of the exact phrase.
    """
    spark = index.sparkSession
    stored = materialise(windows, "test-windows")
    chunks = max(1, -(-stored.count() // CHUNK_WINDOWS))
    found = None
    for i in range(chunks):
        part = stored.where(F.expr(f"pmod(xxhash64(item, terms), {chunks}) = {i}")).collect()
        sent = spark.sparkContext.broadcast(_chunk(part))
        one = index.mapInArrow(_search(sent, near), FOUND)
        found = one if found is None else found.unionByName(one)
    if chunks == 1:
        return found
    return found.groupBy("segment", "slot", "doc_id", "n_words").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
    )


#: Words in the union of sorted spans.
_COVERED = """aggregate(spans, named_struct('end', 0, 'n', 0L), (a, s) -> named_struct('end', greatest(a.end, s.end),
    'n', a.n + greatest(s.end - greatest(a.end, s.start), 0)), a -> a.n)"""


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = find_windows(build_index(docs), windows_of(items, width))
    return found.select(
        "doc_id", "n_words", F.expr(_COVERED).alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items")
    ).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
