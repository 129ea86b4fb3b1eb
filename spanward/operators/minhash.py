"""Likely leakage: candidates by MinHash bands, checked by their tokens, with recall measured against the exact join.

A text's signature is the least of its token hashes under each of ``bands * rows`` permutations; a band is ``rows`` of
them. Two texts of Jaccard similarity s share a band with probability 1 - (1 - s ** rows) ** bands, for any sizes and
whatever their common words. Many texts that are not alike share one too, and their number grows with the product of both
sides: so the keys of a text are dealt together to cells of texts of similar sizes, and pairs that share a key there leave
the cell only if their parity bitmaps leave them in doubt. No such pair is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.factory import LEAKAGE_JACCARD
from ..functions.members import maybe_members
from ..session import materialise
from .leakage import _blocks, signature, signed_candidates, token_sets, verified

BANDS, ROWS = 32, 3
#: Tokens that are permuted at once, as many as fit a core's cache.
PERMUTED = 1 << 14

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    high = x << np.uint64(by)
    x >>= np.uint64(64 - by)
    high |= x
    return high


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of xxhash64, in place."""
    x ^= x >> np.uint64(33)
    x *= P2
    x ^= x >> np.uint64(29)
    x *= P3
    x ^= x >> np.uint64(32)
    return x


def _hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """What SQL's xxhash64 makes of longs, as unsigned numbers."""
    h = _turned(x * P2, 31)
    h *= P1
    h ^= seed + P5 + np.uint64(8)
    h = _turned(h, 27)
    h *= P1
    h += P4
    return _mixed(h)


def band_keys(tokens: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """binary: a 64-bit key per band, the xxhash64 of the band's number and least xxhash64(token hash, permutation)."""

    def keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        seed = _hash_long(flat, np.uint64(42))
        seed += P5 + np.uint64(4)
        out = np.empty((len(starts), bands), np.uint64)
        for b in range(bands):
            key = np.full(len(starts), _hash_long(np.array([b], np.uint64), np.uint64(42))[0])
            for j in range(rows):
                h = _turned(seed ^ np.uint64((b * rows + j) * int(P1) % 2**64), 23)
                h *= P2
                h += P3
                least = np.minimum.reduceat(_mixed(h).view(np.int64), starts)
                key = _hash_long(least.view(np.uint64), key)
            out[:, b] = key
        return out

    def run(hashes: pa.Array) -> pa.Array:
        sets = [h.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if h.is_valid else np.zeros(0, np.uint64) for h in hashes]
        out, some, size = [None] * len(sets), [], 0
        for k, x in enumerate(sets):
            if len(x):
                some.append(k)
                size += len(x)
            if some and (size >= PERMUTED or k == len(sets) - 1):
                lengths = [len(sets[i]) for i in some]
                made = keys(np.concatenate([sets[i] for i in some]), np.cumsum([0, *lengths[:-1]]))
                for i, one in zip(some, made):
                    out[i] = one.tobytes()
                some, size = [], 0
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(F.transform(tokens, lambda t: F.xxhash64(t)))


def likely_leakage(
    test: DataFrame, train: DataFrame, test_id: str, train_id: str, test_text: str = "text", train_text: str = "text",
    threshold: float = LEAKAGE_JACCARD, bands: int = BANDS, rows: int = ROWS, sets: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(test_id, train_id, overlap): for each test text the first training text, by id, found above the threshold.

    Training texts are taken in growing blocks of ascending ids, and a test text leaves with its first match, so that a
    large group of copies on both sides never meets in full. sets: the ``token_sets`` of both sides, if there are any.
    """
    test_sets, train_sets = sets or (token_sets(test, test_id, test_text), token_sets(train, train_id, train_text))

    def marked(sets: DataFrame, name: str) -> DataFrame:
        tokens = F.col("tokens")
        return materialise(sets.select("id", "n", signature(tokens).alias("sig"), band_keys(tokens, bands, rows).alias("marks")), name)

    a, b, out = marked(test_sets, "test-bands"), marked(train_sets, "train-bands"), None
    for block in _blocks(b):
        pairs = materialise(signed_candidates(a, b.where(block), threshold, banded=True), "likely-pairs")
        found = verified(pairs, test_sets, lambda able: maybe_members(train_sets, F.xxhash64("id"), able), threshold)
        hits = materialise(found, "matches")
        out = hits if out is None else out.unionByName(hits)
        a = a.join(hits.select("id"), "id", "left_anti")
    return out.select(F.col("id").alias("test_id"), "train_id", "overlap")


def recall(exact: DataFrame, likely: DataFrame, test: DataFrame, test_id: str, group: str) -> DataFrame:
    """Per group of test texts: how many the exact join finds, how many of them the other one does, and their ratio."""
    truth = exact.select("test_id").join(test.select(F.col(test_id).alias("test_id"), group), "test_id")
    met = truth.join(likely.select("test_id", F.lit(1).alias("hit")), "test_id", "left")
    counts = met.groupBy(group).agg(F.count(F.lit(1)).alias("leaked"), F.count("hit").alias("found"))
    return counts.withColumn("recall", F.col("found") / F.col("leaked"))
