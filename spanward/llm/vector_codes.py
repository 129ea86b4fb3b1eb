"""Product codes of vectors with integer codebooks: exact rounds of assignment and averaging over Hilbert-sorted blocks.

Components become integers, vectors are cut into equal parts. Each task cuts its vectors into chunks; in a chunk, the
points of each part are sorted along a Hilbert curve and cut into flat blocks that store the corners of their box and
their sum. In a round, an entry whose nearest possible distance to a block's box is beyond some entry's farthest one is
nearest to no point of the block; what is left is the block's shortlist. One entry left takes the block by its stored
sum; several are compared by a small integer kernel. Boxes only prune: results are those of comparing everything.

Vectors stay where they are: a round sends a task's sums for each entry, and the driver holds the codebooks alone
(``entries`` times the dimension). Integers are 64 bits wide where all squares fit, and Python's beyond that; sums travel
in 48-bit limbs. So components of any finite size are exact.

Defined cases: rows whose vector is null or holds null or non-finite components take no part, nor do rows whose length
is not that of the smallest kept id (ids in ascending order, nulls last, equal ids by their vectors) or is no multiple of
the number of parts; with fewer vectors than entries a codebook has as many entries as vectors; repeated rows count one
by one; null labels are one label; an error that does not fit a long is null, and so is a sum with it; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialise, ship
from .arrow import binary

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bytes of components in a chunk, and points in a block.
CHUNK_BYTES = 1 << 23
BLOCK = 128
CHUNKS = "ids array<bigint>, labels array<{label}>, block int, wide boolean, points binary, places binary, low binary, high binary, sums array<binary>"
LIMB = 48


def narrow_limit(dim: int) -> int:
    """Components up to this give distances of whole vectors below 2**63."""
    return math.isqrt(((1 << 63) - 1) // dim) // 2 - 1


def to_integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly; int64 where it is small, else Python's integers."""
    if not x.size or np.abs(x).max() < 2.0**40 / scale:
        return np.floor(x * float(scale)).astype(np.int64)
    whole = [int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale) for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = whole
    return out.reshape(x.shape)


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Places of points (n, d) along a Hilbert curve through their bounding box; beyond 63 dimensions, of the first 63."""
    n, d = points.shape[0], min(points.shape[1], 63)
    bits = max(1, min(16, 63 // d))
    x = points[:, :d].astype(np.float64)
    low = x.min(axis=0)
    span = np.maximum(x.max(axis=0) - low, 1e-300)
    cells = np.minimum(((x - low) / span * (1 << bits)), (1 << bits) - 1).astype(np.int64).T.copy()
    level = 1 << (bits - 1)
    while level > 1:  # undo the turns of the sub-cubes, from the largest
        below = level - 1
        for i in range(d):
            inside = (cells[i] & level) != 0
            swap = np.where(inside, 0, (cells[0] ^ cells[i]) & below)
            cells[0] ^= np.where(inside, below, swap)
            cells[i] ^= swap
        level >>= 1
    for i in range(1, d):
        cells[i] ^= cells[i - 1]
    turn, level = np.zeros(n, np.int64), 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(cells[d - 1] & level, level - 1, 0)
        level >>= 1
    cells ^= turn
    keys = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            keys = keys << 1 | (cells[i] >> bit & 1)
    return keys


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, part) with value = sum of part << (48 * place); parts add up place by place."""
    place = 0
    while not -(1 << LIMB - 1) <= value < 1 << LIMB - 1:
        yield place, value & (1 << LIMB) - 1
        value >>= LIMB
        place += 1
    yield place, value


def _chunked(parts: int, dim: int, label: pa.DataType, block: int):
    width, size = dim // parts, max(block, CHUNK_BYTES // (8 * dim))
    limit = narrow_limit(dim)

    def chunk(ids: list, labels: list, x: np.ndarray) -> tuple:
        ints = to_integers(x)
        wide = ints.dtype == object or (ints.size and int(np.abs(ints).max()) > limit)
        points, places, low, high, sums = [], [], [], [], []
        for p in range(parts):
            own = slice(p * width, (p + 1) * width)
            order = np.argsort(hilbert_keys(x[:, own] if wide else ints[:, own]), kind="stable").astype(np.int32)
            mine, raw = ints[order, own], x[order, own]
            at = np.arange(0, len(order), block)
            places.append(order)
            points.append(raw if wide else mine)
            low.append(np.minimum.reduceat(points[-1], at))
            high.append(np.maximum.reduceat(points[-1], at))
            sums.append([[str(v) for v in mine[a : a + block].sum(axis=0)] for a in at] if wide else np.add.reduceat(mine, at))
        packed = ["\n".join(",".join(b) for b in s).encode() for s in sums] if wide else [binary(s) for s in sums]
        return ids, labels, block, bool(wide), binary(np.concatenate(points)), binary(np.concatenate(places)), binary(np.concatenate(low)), binary(np.concatenate(high)), packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int64()), pa.list_(label), pa.int32(), pa.bool_(), *[pa.binary()] * 4, pa.list_(pa.binary())]
        names = ["ids", "labels", "block", "wide", "points", "places", "low", "high", "sums"]
        ids, labels, rows, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            made = chunk(ids, labels, np.concatenate(rows))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, kinds)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                if held and held + part.num_rows > size:
                    yield flush()
                    ids, labels, rows, held = [], [], [], 0
                ids += part.column(0).to_pylist()
                labels += part.column(1).to_pylist()
                rows.append(part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim))
                held += part.num_rows
        if held:
            yield flush()

    return run


class Chunk:
    """One stored chunk with its blocks."""

    def __init__(self, row: dict, parts: int, width: int):
        self.ids, self.labels, self.parts, self.width = row["ids"], row["labels"], parts, width
        n, self.block = len(self.ids), row["block"]
        self.places = np.frombuffer(row["places"], np.int32).reshape(parts, n)
        wide, blocks = row["wide"], -(-n // self.block)
        kind = np.float64 if wide else np.int64
        points, low, high = (np.frombuffer(row[c], kind).reshape(parts, m, width) for c, m in (("points", n), ("low", blocks), ("high", blocks)))
        if wide:
            points, low, high = (to_integers(a) for a in (points, low, high))
            sums = [[[int(v) for v in b.split(",")] for b in s.decode().split("\n")] for s in row["sums"]]
            self.sums = np.array(sums, object).reshape(parts, blocks, width)
        else:
            self.sums = np.stack([np.frombuffer(s, np.int64).reshape(blocks, width) for s in row["sums"]])
        self.points, self.low, self.high = points, low, high

    def shortlists(self, p: int, book: np.ndarray) -> np.ndarray:
        """[block, entry]: can the entry be nearest to a point in the block's box?"""
        low, high, c = self.low[p][:, None], self.high[p][:, None], book[None]
        zero = np.zeros(1, dtype=book.dtype)
        gap = np.maximum(np.maximum(low - c, c - high), zero)
        reach = np.maximum(np.abs(c - low), np.abs(high - c))
        nearest, farthest = (gap * gap).sum(axis=2), (reach * reach).sum(axis=2)
        return nearest <= farthest.min(axis=1)[:, None]

    def blocks(self, p: int, book: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        """(block, its points, its shortlist in ascending order)."""
        n = len(self.ids)
        for b, able in enumerate(self.shortlists(p, book)):
            yield b, slice(b * self.block, min((b + 1) * self.block, n)), np.flatnonzero(able)


def _kernel(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances [point, entry]."""
    apart = points[:, None] - entries[None]
    return (apart * apart).sum(axis=2)


def _ready(row: dict, books: list, parts: int, width: int, limit: int) -> tuple[Chunk, list]:
    """A chunk and codebooks of one kind of integers: 64 bits if those of both are small enough."""
    chunk = Chunk(row, parts, width)
    if row["wide"] or any(abs(v) > limit for b in books for v in b.ravel().tolist()):
        for c in ("points", "low", "high", "sums"):
            setattr(chunk, c, getattr(chunk, c).astype(object))
        return chunk, [b.astype(object) for b in books]
    return chunk, [b.astype(np.int64) for b in books]


def _round(books: list, parts: int, width: int):
    """(slot, limb place, sum of limbs, n) of one task; a slot is a component of an entry of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = narrow_limit(parts * width)
        k = len(books[0])
        totals, members = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, own = _ready(batch.slice(i, 1).to_pylist()[0], books, parts, width, limit)
                for p in range(parts):
                    sums, counts = np.zeros((k, width), own[p].dtype), np.zeros(k, np.int64)
                    for b, at, able in chunk.blocks(p, own[p]):
                        if len(able) == 1:
                            sums[able[0]] += chunk.sums[p][b]
                            counts[able[0]] += at.stop - at.start
                            continue
                        points = chunk.points[p][at]
                        best = able[_kernel(points, own[p][able]).argmin(axis=1)]
                        np.add.at(sums, best, points)
                        counts += np.bincount(best, minlength=k)
                    totals[p] += sums.astype(object)
                    members[p] += counts
        rows = [
            ((p * k + e) * width + j, place, limb, int(members[p, e]) if place == 0 else 0)
            for p in range(parts) for e in range(k) if members[p, e] for j in range(width) for place, limb in _limbs(int(totals[p, e, j]))
        ]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["slot", "place", "limb", "n"])

    return run


def _coded(books: list, parts: int, width: int, label: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = narrow_limit(parts * width)
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, own = _ready(batch.slice(i, 1).to_pylist()[0], books, parts, width, limit)
                n = len(chunk.ids)
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, own[0].dtype)
                for p in range(parts):
                    for _, at, able in chunk.blocks(p, own[p]):
                        apart = _kernel(chunk.points[p][at], own[p][able])
                        best, rows = apart.argmin(axis=1), chunk.places[p][at]
                        codes[rows, p] = able[best]
                        error[rows] += apart[np.arange(len(best)), best]
                fits = [int(e) if e < 1 << 63 else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk.ids, pa.int64()), pa.array(chunk.labels, label), pa.array([c.tobytes().hex() for c in codes]), pa.array(fits, pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return run


def usable(vectors: DataFrame, parts: int, id_col: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v) of vectors that hold finite components only and can be cut into parts."""
    finite = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = vectors.where(f"{vector} IS NOT NULL AND size({vector}) > 0 AND size({vector}) % {parts} = 0 AND {finite}")
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))


def book_digest(books: list) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector: str = "embedding",
    label: str = "label", block: int = BLOCK,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, parts, id_col, vector, label)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).select(F.size("v").alias("dim")).first()
    if first is None:
        return rows.selectExpr(
            "vec_id", "CAST(NULL AS string) AS code", "CAST(NULL AS bigint) AS error", "CAST(NULL AS bigint) AS label_error",
            "CAST(NULL AS string) AS codebooks_sha256",
        ).where("false")
    dim, width = first.dim, first.dim // parts
    rows = rows.where(F.size("v") == dim)
    seeds = to_integers(np.array([r.v for r in rows.orderBy(*order).limit(entries).select("v").collect()]))
    books = [seeds[:, p * width : (p + 1) * width].astype(object) for p in range(parts)]

    kind = vectors.schema[label].dataType
    arrow_kind = to_arrow_type(kind)
    chunks = materialise(rows.mapInArrow(_chunked(parts, dim, arrow_kind, block), CHUNKS.format(label=kind.simpleString())), "vector-chunks")
    for _ in range(rounds):
        books = averaged(chunks.mapInArrow(_round(books, parts, width), "slot int, place int, limb bigint, n bigint"), books)
    schema = f"vec_id bigint, label {kind.simpleString()}, code string, error bigint"
    coded = materialise(chunks.mapInArrow(_coded(books, parts, width, arrow_kind), schema), "vector-codes")
    total = "IF(bool_or(error IS NULL), NULL, try_cast(sum(CAST(error AS decimal(38, 0))) AS bigint))"
    by_label = materialise(coded.groupBy("label").agg(F.expr(total).alias("label_error")), "label-errors")
    out = coded.join(by_label.withColumnRenamed("label", "_label"), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def averaged(sums: DataFrame, books: list) -> list:
    """Codebooks whose entries are the floored means of their points; entries without points stay.

    What comes to the driver is a few rows per component of an entry, whatever the number of vectors.
    """
    k, width = books[0].shape
    total: dict[int, int] = defaultdict(int)
    members: dict[int, int] = {}
    for r in sums.groupBy("slot", "place").agg(F.sum(F.col("limb").cast("decimal(38,0)")).alias("limb"), F.sum("n").alias("n")).collect():
        total[r.slot] += int(r.limb) << (LIMB * r.place)
        if r.place == 0:
            members[r.slot] = r.n
    out = [b.copy() for b in books]
    for slot, n in members.items():
        e, j = divmod(slot, width)
        out[e // k][e % k, j] = total[slot] // n
    return out
