"""Language of a text by rank-order n-gram profiles.

A profile is the most frequent character n-grams (one to three letters, words padded by blanks) of a language in order
of frequency; so is a document's own. Their out-of-place distance adds up, over the document's n-grams, how far each
is from its place in the profile, or the most possible if it is not there. The nearest language is predicted.

Counts cover every training document; they are summed per slice of a task and by key afterwards. What is broadcast are
the profiles, ``PROFILE`` n-grams for each value of the language column.

Defined cases: null text, or text without a letter, gives ``und`` and score 0, as does any text if nothing was
learned; equal distances go to the smaller language; rows with null language teach nothing; repeated rows count
again; null ids count as not held out; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .arrow import U, row_slices

#: n-grams of a profile, and of a document that are compared with it.
PROFILE = 300
_BLANK = 32
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(texts: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, gram, count) in order of group and gram; ``group`` has one small number per text.

    A gram is its code points in one number, 21 bits each, the first one highest.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    owner = np.repeat(group, [len(t) + 1 for t in lowered])[: len(codes)]
    # one blank between words, one at either end
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    blank_again = keep & ~letter
    blank_again[0:1] = False
    again = np.zeros(len(codes), bool)
    again[1:] = ~letter[1:] & ~letter[:-1]
    codes, letter, owner = np.where(letter, codes, _BLANK)[keep], letter[keep], owner[keep]
    if not letter.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    codes = np.concatenate([[_BLANK], codes, [_BLANK]])
    letter = np.concatenate([[False], letter, [False]])
    owner = np.concatenate([owner[:1], owner, owner[-1:]])
    symbols = np.flatnonzero(np.bincount(codes, minlength=1))
    small = np.zeros(symbols[-1] + 1, np.int64)
    small[symbols] = np.arange(1, len(symbols) + 1)
    c = small[codes]
    bits = int(len(symbols)).bit_length()
    one = (c << 2 * bits)[letter], owner[letter]
    pair = letter[:-1] | letter[1:]
    two = ((c[:-1] << 2 * bits) | (c[1:] << bits))[pair], np.where(letter[:-1], owner[:-1], owner[1:])[pair]
    middle = letter[1:-1]
    three = ((c[:-2] << 2 * bits) | (c[1:-1] << bits) | c[2:])[middle], owner[1:-1][middle]
    grams = np.concatenate([one[0], two[0], three[0]])
    owners = np.concatenate([one[1], two[1], three[1]]).astype(np.int64)
    if int(owners.max()).bit_length() + 3 * bits < 63:
        rows = np.sort((owners << 3 * bits) | grams)
        owners, grams = rows >> 3 * bits, rows & ((1 << 3 * bits) - 1)
    else:
        order = np.lexsort((grams, owners))
        owners, grams = owners[order], grams[order]
    head = np.ones(len(grams), bool)
    head[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    at = np.flatnonzero(head)
    wide, low = np.concatenate([[0], symbols]).astype(np.int64), (1 << bits) - 1
    g = grams[at]
    full = (wide[g >> 2 * bits] << 2 * _BITS) | (wide[(g >> bits) & low] << _BITS) | wide[g & low]
    return owners[at], full, np.diff(np.append(at, len(grams)))


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches, "text"):
        langs = batch.column(0).dictionary_encode()
        names = langs.dictionary.to_pylist()
        group, gram, n = gram_counts(_texts(batch.column(1)), langs.indices.to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in group], pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, list[int]]:
    """Grams of every language from frequent to rare; ties go to the smaller gram."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_learn, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def _predict(profiles: dict[str, list[int]], size: int):
    names = sorted(profiles)
    known = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
    place = np.full((len(names), len(known) + 1), -1, np.int64)
    for i, name in enumerate(names):
        place[i, np.searchsorted(known, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            m = batch.num_rows
            doc, gram, n = gram_counts(_texts(batch.column(1)), np.arange(m))
            best, score = np.full(m, "und", dtype=object), np.zeros(m)
            if len(doc) and names:
                top = int(n.max()) + 1
                order = np.argsort(doc * top + (top - 1 - n), kind="stable")  # by document, then frequent first
                doc, gram = doc[order], gram[order]
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
                use = rank < size
                doc, gram, rank = doc[use], gram[use], rank[use]
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                at = np.where(known[at] == gram, at, len(known))
                away = [np.add.reduceat(np.where(p[at] < 0, size, np.abs(p[at] - rank)), first) for p in place]
                away = np.array(away)
                near = away.argmin(axis=0)
                grams = np.diff(np.append(first, len(doc)))
                best[doc[first]] = np.array(names, dtype=object)[near]
                score[doc[first]] = 1 - away.min(axis=0) / (grams * size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(best), pa.string()), pa.array(np.clip(score, 0, 1))],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score); the score is one less the share of the largest possible distance."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return rows.mapInArrow(_predict(profiles, size), "doc_id bigint, held_out boolean, lang_pred string, score double")
