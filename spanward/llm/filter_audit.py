"""How filters of a corpus overlap, in every order they can be applied in, from sorted posting lists.

One pass measures every text. Per part and range of ids, each filter keeps the sorted list of the documents that fail
it, and so do the labels of interest. Unions of lists are built by merging, and what a filter removes after others is
its list without their union; both walk the longer list in galloping steps. Sizes are summed over ranges, so a part with
a third of all rows is many ranges, and no list is longer than a range.

Defined cases: a null text is the empty one; a null part is the empty string; repeated rows count one by one; a null id
is larger than none and smaller than none and has no label; a range holds at most ``RANGE`` ids, whatever the number of rows, since equal
rows are counted before lists are made; a document is good (toxic) if any of its labels says so; no rows give no rows;
other columns are ignored. A text is measured whole and held once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship, small_table
from .arrow import Prefix, binary, flat, row_slices, word_bounds

#: Ids of one range.
RANGE = 1 << 12
#: Parts whose sums a task holds before it sends them on.
FLUSH = 512
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80

#: Failure conditions on the measures of a text.
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_upper > 5 * n_chars",
    "D": "marked",
    "E": "coalesce(id > first_id, false)",
}
MEASURES = "part string, id bigint, n_words bigint, n_distinct bigint, n_upper bigint, n_chars bigint, marked boolean, body binary"
LISTS = "part string, span bigint, ids binary, weights binary, lists array<binary>, good binary, toxic binary"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches, "text"):
        data, offsets = flat(batch.column(2))
        starts, ends, first = word_bounds(data, offsets, _WORD)
        n_words = np.diff(first)
        rows = np.repeat(np.arange(len(n_words)), n_words)
        words = Prefix(data).hashes(starts, ends)
        order = np.lexsort((words, rows))
        words, rows = words[order], rows[order]
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
        n_distinct = np.bincount(rows[fresh], minlength=len(n_words))
        counts = []
        for kind in (_UPPER, _FIRST, _MARKS):
            sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
            counts.append(sums[offsets[1:]] - sums[offsets[:-1]])
        view = memoryview(data)
        bodies = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in (n_words, n_distinct, counts[0], counts[1])],
             pa.array(counts[2] > 0), pa.array(bodies, pa.binary())],
            MEASURES_NAMES,
        )


MEASURES_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def measure(docs: DataFrame, part: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """What the filters look at, one row per document; ``body`` names the text by its content."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_measured, MEASURES)


def failures(measured: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """(part, id, mask, n): equal rows once, with their number; bit i of the mask is the i-th filter."""
    copies = measured.groupBy("body").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    known = measured.join(materialise(copies.select("body", "first_id"), "copies"), "body", "left")
    mask = " + ".join(f"IF({condition}, {1 << i}, 0)" for i, condition in enumerate(filters.values()))
    return known.selectExpr("part", "id", f"{mask} AS mask").groupBy("part", "id", "mask").agg(F.count(F.lit(1)).alias("n"))


def _listed(n_filters: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("mask", "ascending")])
        mask = table["mask"].to_numpy()
        lists = [binary(np.flatnonzero(mask >> i & 1).astype(np.int32)) for i in range(n_filters)]
        ids = table["id"].combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy()
        marked = [binary(np.flatnonzero(table[c].to_numpy()).astype(np.int32)) for c in ("good", "toxic")]
        return pa.table({
            "part": table["part"].slice(0, 1), "span": table["span"].slice(0, 1), "ids": pa.array([binary(ids)], pa.binary()),
            "weights": pa.array([binary(table["n"].to_numpy().astype(np.int64))], pa.binary()), "lists": pa.array([lists], pa.list_(pa.binary())),
            "good": pa.array(marked[:1], pa.binary()), "toxic": pa.array(marked[1:], pa.binary()),
        })

    return run


def postings(failed: DataFrame, labels: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """Per part and range of ids: the documents in id order with their numbers of rows, and the places in that order of
    those that fail each filter, are good or are toxic."""
    said = labels.select(F.col("doc_id").cast("bigint").alias("id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
    said = said.groupBy("id").agg(F.max("g").alias("g"), F.max("t").alias("t")).where("g OR t")
    rows = failed.join(said, "id", "left").selectExpr(
        "part", f"coalesce(floor(id / {RANGE}D), 0) AS span", "id", "mask", "n", "CAST(coalesce(g, false) AS int) AS good", "CAST(coalesce(t, false) AS int) AS toxic"
    )
    return rows.groupBy("part", "span").applyInArrow(_listed(n_filters), LISTS)


def within(some: np.ndarray, others: np.ndarray, block: int = 256) -> np.ndarray:
    """Which of ``some`` are in ``others``, both sorted.

    Per block of ``some``, the place in ``others`` gallops forward, by doubled steps, past the block's last; the block
    is then searched between the old place and the new one.
    """
    out, at = np.zeros(len(some), bool), 0
    for i in range(0, len(some), block):
        part, step, end = some[i : i + block], 1, at
        while end < len(others) and others[end] <= part[-1]:
            end, step = end + step, step * 2
        window = others[at : min(end, len(others))]
        if len(window):
            place = np.searchsorted(window, part)
            hit = place < len(window)
            hit[hit] = window[place[hit]] == part[hit]
            out[i : i + block] = hit
        at += int(np.searchsorted(window, part[-1], "right"))
        if at >= len(others):
            break
    return out


def without(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    return some[~within(some, others)]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union of two sorted lists: the shorter one is placed into the longer one."""
    if len(a) < len(b):
        a, b = b, a
    rest = without(b, a)
    return np.insert(a, np.searchsorted(a, rest), rest)


def interactions(lists: list[np.ndarray], weights: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """[before, filter] -> (lost, good lost, toxic lost, gone in all): for each set of earlier filters and each other one."""
    k = len(lists)
    union = [np.zeros(0, np.int32)]
    for before in range(1, 1 << k):  # one list more than a union made earlier
        top = before.bit_length() - 1
        union.append(merged(union[before ^ (1 << top)], lists[top]))
    size = [int(weights[u].sum()) for u in union]
    out = np.zeros((1 << k, k, 4), np.int64)
    for before in range(1 << k):
        for f in range(k):
            if not before >> f & 1:
                lost = without(lists[f], union[before])
                sums = [weights[lost].sum(), *(weights[lost[within(lost, x)]].sum() for x in (good, toxic)), size[before | 1 << f]]
                out[before, f] = sums
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple] = {}

    def flush() -> pa.RecordBatch:
        rows = []
        for part, (n, sums) in held.items():
            k = sums.shape[1]
            rows += [(part, b, f, n, *sums[b, f].tolist()) for b in range(1 << k) for f in range(k) if not b >> f & 1]
        columns = list(zip(*rows)) or [[]] * 8
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["part", "before", "f", "n", "lost", "good", "toxic", "gone"])

    for batch in batches:
        for row in batch.to_pylist():
            weights = np.frombuffer(row["weights"], np.int64)
            lists = [np.frombuffer(x, np.int32) for x in row["lists"]]
            sums = interactions(lists, weights, np.frombuffer(row["good"], np.int32), np.frombuffer(row["toxic"], np.int32))
            n, old = held.get(row["part"], (0, 0))
            held[row["part"]] = (n + int(weights.sum()), old + sums)
            if len(held) >= FLUSH:
                yield flush()
    yield flush()


def orders(spark, names: str) -> DataFrame:
    """(filter_order, step, f, before) of every order."""
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, f, before))
            before |= 1 << f
    return small_table(spark, rows, "filter_order string, step int, f int, before int")


def audit(lists: DataFrame, names: str = "".join(FILTERS)) -> DataFrame:
    """One row per part, order and step.

    ``shapley`` sums what a filter removes over all orders: a set of s earlier filters comes before it in s! (k - 1 - s)!.
    """
    spark, k = lists.sparkSession, len(names)
    ship(spark)
    kinds = "part string, before int, f int, n bigint, lost bigint, good bigint, toxic bigint, gone bigint"
    sums = lists.mapInArrow(_summed, kinds).groupBy("part", "before", "f").agg(*[F.sum(c).alias(c) for c in ("n", "lost", "good", "toxic", "gone")])
    sums = materialise(sums, "interactions")
    ways = f"factorial(bit_count(before)) * factorial({k - 1} - bit_count(before))"
    whole = sums.groupBy("part", "f").agg(
        F.expr("sum(IF(before = 0, lost, 0))").alias("fails"),
        F.expr(f"sum(IF(bit_count(before) = {k - 1}, lost, 0))").alias("unique_fails"),
        F.expr(f"sum({ways} * lost)").alias("shapley"),
    )
    return sums.join(F.broadcast(orders(spark, names)), ["f", "before"]).join(whole, ["part", "f"]).selectExpr(
        "part", "filter_order", "step", "n - gone AS kept", "lost AS removed", "fails - lost AS redundant", "unique_fails",
        "good AS good_lost", "toxic AS toxic_lost", "shapley",
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    measured = materialise(measure(docs, part), "measures")
    return audit(materialise(postings(failures(measured), labels), "postings"))
