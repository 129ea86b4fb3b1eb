"""Documents linked by the Jaccard similarity of their word shingles, by PartEnum signatures.

Sets whose sizes are in one band or the next can differ in at most k shingles if they are similar. The hash space is
cut into n1 * n2 cells; in each group of n2 cells every choice of n2 - k2 cells gives a signature, and since
n1 * (k2 + 1) > k, some group differs in k2 cells at most, so similar sets share a signature. Bands hold sizes up to
1 / threshold times their smallest, and a set signs for its own band and the next, so no pair is missed.

Equal sets are one class from the start. Signatures meet in hash buckets as packed arrays. A signature of up to
``SHARED`` classes proposes all their pairs, so that it hides none. One of more classes is open: it proposes pairs of
its smallest class with the others. A task sends the first ``SHARED`` + 1 classes of each signature and proposes the
pairs of the rest itself, so a signature that a third of all documents share is a few entries per task and nobody forms
all its pairs. Proposed pairs that can be similar by their sizes are checked exactly. Where a pair of an open signature
fails, by its sizes or by the check, members of it may be linked in other ways; those are found by their differences
from a centre (``_past_failures``).

Defined cases: null or empty text, or text without words, has an empty set and is linked with nothing; repeated rows
are documents of their own; null ids are carried and never name a component unless all are null; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship, slices
from .arrow import LOWER_VALUE, Prefix, U, binary, flat, mix, packed_texts, release, row_slices, unpacked, word_bounds
from .graph import components

#: Signatures that a task holds before it sends them on, and buckets for each shuffle partition they are sent to: what is
#: sorted at once is a bucket.
FLUSH = 500_000
BUCKETS = 4
#: A signature of up to so many classes proposes all their pairs; of more, a star.
SHARED = 16
#: Sets of up to so many different shingles use one group of cells.
SMALL_DISTANCE = 3
#: Below so many shingles a cell, cells sign in groups of three, two at a time: single ones are often empty or common.
THIN, GROUP = 6, 3
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)


def _times(n: int, factor: int) -> U:
    """``n`` times one of the factors, modulo 2**64."""
    return U(n * int(_FACTORS[factor]) % (1 << 64))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; fewer words than ``width`` are one shingle."""
    data, offsets = flat(column)
    starts, ends, first = word_bounds(data, offsets, _WORD)
    words = Prefix(data, LOWER_VALUE).hashes(starts, ends)
    n = len(words) - width + 1
    rows = np.zeros(max(n, 0), U)
    for j in range(width if n > 0 else 0):
        rows += words[j : j + n] * U(pow(int(_FACTORS[j % 5]), 1 + j // 5, 1 << 64))
    rows = mix(rows)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(rows[a : b - width + 1])
        elif b > a:
            few = np.array([b - a], U)
            for h in words[a:b]:
                few = mix(few * _FACTORS[0] + h)
            yield few
        else:
            yield np.zeros(0, U)


def fingerprint(rows: np.ndarray) -> int:
    """Of a set, whatever its order, as a signed long."""
    total = mix(rows + _FACTORS[1]).sum(dtype=U, keepdims=True) + _times(len(rows), 3)
    return int(mix(total).view(np.int64)[0])


class Signatures:
    """PartEnum signatures for a Jaccard threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [1]
        # shingles a cell would hold in the smallest sets of a band, if each cell signed alone
        self.grouped = (num + den) * num**2 < THIN * 2 * (den - num) * den**2

    def band(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append((self.tops[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.tops, size))

    def distance(self, band: int) -> int:
        """The most that two similar sets of at most the band's largest size differ in."""
        self.band(self.tops[-1] + 1) if band >= len(self.tops) else None
        return 2 * self.tops[band] * (self.den - self.num) // (self.den + self.num)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Of a sorted set of hashes."""
        band, sums = self.band(len(rows)), np.zeros(len(rows) + 1, U)
        np.cumsum(mix(rows ^ _FACTORS[2]), out=sums[1:])
        out = []
        for instance in (band, band + 1):
            k = self.distance(instance)
            if k:
                sign = _groups if self.grouped and k > SMALL_DISTANCE else _cells
                out.append(sign(rows, sums, k) + _times(instance, 4))
        return mix(np.concatenate(out)) if out else np.zeros(0, U)


@lru_cache(maxsize=4096)
def _plan(k: int) -> tuple[np.ndarray, list, int]:
    """Cell borders, choices of cells (none: each cell alone) and how many cells may be passed over if empty."""
    if k <= SMALL_DISTANCE:
        n = k + 2
        choices = list(combinations(range(n), n - k))
        spare = 0
    else:
        n = 2 * ((k + 4) // 2)  # n1 groups of n2 = 2 cells with k2 = 1; two cells more than the least number
        choices, spare = [], n - k - 1
    return _cuts(n), choices, spare


def _cuts(n: int) -> np.ndarray:
    return np.array([(i << 64) // n for i in range(1, n)], U)


@lru_cache(maxsize=4096)
def _group_plan(k: int) -> tuple[np.ndarray, int]:
    """Cell borders of groups of ``GROUP`` cells, and how many groups more there are than k / 2."""
    least = k // 2 + 1
    spare = 2 + least // 8
    return _cuts(GROUP * (least + spare)), spare


def _groups(rows: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """The sums of all but one cell of each group.

    At most k / 2 groups of similar sets differ in two cells or more; in the others some choice of all cells but one
    agrees. A group is poor if all but one of its cells are empty, so that a choice of it may say nothing. A set with no
    more poor groups than there are spare ones agrees with a similar one in a group that is not poor, by a choice that
    holds shingles: it signs no empty choices. The few other sets sign all.
    """
    borders, spare = _group_plan(k)
    at = np.concatenate([[0], np.searchsorted(rows, borders), [len(rows)]])
    cells = np.diff(sums[at])
    salted = mix(cells + np.arange(1, len(cells) + 1).astype(U) * _FACTORS[0]).reshape(-1, GROUP)
    full = (at[1:] > at[:-1]).reshape(-1, GROUP)
    whole = salted.sum(axis=1, dtype=U)[:, None]
    out, says = whole - salted, full.sum(axis=1)[:, None] - full > 0
    return out[says] if (~says).any(axis=1).sum() <= spare else out.ravel()


def _cells(rows: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    """The sums of chosen cells.

    At least n - k cells of similar sets agree. A set with fewer empty cells than that agrees in one that is not
    empty, so its empty cells are passed over.
    """
    borders, choices, spare = _plan(k)
    at = np.concatenate([[0], np.searchsorted(rows, borders), [len(rows)]])
    cells = np.diff(sums[at])
    number = np.arange(1, len(cells) + 1).astype(U)
    if choices:
        salted = mix(cells + number * _FACTORS[0])
        return np.array([salted[list(c)].sum(dtype=U) for c in choices], U) + np.arange(len(choices)).astype(U) * _FACTORS[3]
    full = at[1:] > at[:-1]
    out = cells + number * _FACTORS[0]
    return out[full] if len(full) - full.sum() <= spare else out


def _meta(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            sets = [(len(s), fingerprint(s) if len(s) else None) for s in shingle_sets(batch.column(2), width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in sets], pa.int64()), pa.array([f for _, f in sets], pa.int64())],
                ["doc_key", "doc_id", "n", "fp"],
            )

    return run


def _by_key(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, owner) in order, where the key of each begins and how many owners it has."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[fresh], owners[fresh]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(head)
    n = np.diff(np.append(at, len(keys)))
    return keys, owners, np.repeat(at, n), np.repeat(n, n)


def _pairs(keys: np.ndarray, owners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(a, b, open): all pairs of owners of a key that has up to ``SHARED``, the smallest with the others of an open one."""
    _, owners, first, n = _by_key(keys, owners)
    place, few = np.arange(len(owners)), n <= SHARED
    for gap in range(1, SHARED):
        at = np.flatnonzero(few & (place - first >= gap))
        yield owners[at - gap], owners[at], False
    at = np.flatnonzero(~few & (place > first))
    yield owners[first[at]], owners[at], True


def _sign(width: int, num: int, den: int, buckets: int):
    """Packed signatures per bucket (pairs = false) and pairs proposed by open ones (pairs = true) of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, part = Signatures(num, den), TaskContext.get().partitionId()
        keys, owners, seen, held = [], [], set(), 0

        def flush() -> pa.RecordBatch:
            k = np.concatenate(keys) if keys else np.zeros(0, U)
            o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
            k, o, first, _ = _by_key(k, o)
            more = np.arange(len(k)) - first > SHARED  # the bucket sees from the others that the signature is open
            a, b, k, o = o[first[more]], o[more], k[~more], o[~more]
            ends = np.searchsorted(k, np.array([(i << 64) // buckets for i in range(1, buckets)], U))
            ends = np.concatenate([[0], ends, [len(k)]])
            full = [i for i in range(buckets) if ends[i + 1] > ends[i]]
            rows = [(i, False, binary(k[ends[i] : ends[i + 1]]), binary(o[ends[i] : ends[i + 1]])) for i in full]
            if len(a):
                rows.append((part % buckets, True, binary(a), binary(b)))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["bucket", "pairs", "x", "y"])

        for batch in row_slices(batches, "text"):
            for rows in shingle_sets(batch.column(0), width):
                fp = fingerprint(rows) if len(rows) else None
                if fp is None or fp in seen:
                    continue
                seen.add(fp)
                own = make.of(rows)
                keys.append(own)
                owners.append(np.full(len(own), fp, np.int64))
                held += len(own)
            if held > FLUSH:
                yield flush()
                keys, owners, held = [], [], 0
        yield flush()

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Proposed pairs of one bucket with the number of signatures behind them, and whether an open one is among these."""
    release()
    proposed, keys, owners = [], [], []
    for pairs, x, y in zip(table["pairs"].to_pylist(), table["x"].to_pylist(), table["y"].to_pylist()):
        if pairs:
            proposed.append((np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), True))
        else:
            keys.append(np.frombuffer(x, U))
            owners.append(np.frombuffer(y, np.int64))
    if keys:
        proposed += _pairs(np.concatenate(keys), np.concatenate(owners))
    a, b = (np.concatenate([p[i] for p in proposed]) for i in (0, 1))
    opened = np.repeat([p[2] for p in proposed], [len(p[0]) for p in proposed])
    order = np.lexsort((b, a))
    a, b, opened = a[order], b[order], opened[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(head)
    some = np.maximum.reduceat(opened, at) if len(at) else opened
    return pa.table({"a": a[at], "b": b[at], "n": np.diff(np.append(at, len(a))), "open": some})


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = pa.array([unpacked(b).decode("utf-8", "replace") for b in part.column(1).to_pylist()], pa.large_string())
                sets = [s.view(np.int64) for s in shingle_sets(texts, width)]
                sizes = np.cumsum([0] + [len(s) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(sets), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["fp", "shingles"])

    return run


def _alone_keys(buckets: int):
    """Shingles of one task with the class that has them; those of several classes as pairs = true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, held = [], [], 0

        def flush() -> pa.RecordBatch:
            k = np.concatenate(keys) if keys else np.zeros(0, U)
            o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
            order = np.argsort(k)
            k, o = k[order], o[order]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            single = np.diff(np.append(at, len(k))) == 1
            rows = []
            for several, part in ((False, at[single]), (True, at[~single])):
                ends = np.searchsorted(k[part], np.array([(i << 64) // buckets for i in range(1, buckets)], U))
                ends = np.concatenate([[0], ends, [len(part)]])
                for i in range(buckets):
                    own = part[ends[i] : ends[i + 1]]
                    if len(own):
                        rows.append((i, several, binary(k[own]), b"" if several else binary(o[own])))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["bucket", "pairs", "x", "y"])

        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                keys.append(lists.flatten().to_numpy().view(U))
                owners.append(np.repeat(part.column(0).to_numpy(), sizes))
                held += len(keys[-1])
                if held > FLUSH:
                    yield flush()
                    keys, owners, held = [], [], 0
        yield flush()

    return run


def _alone(buckets: int):
    """How many shingles of one bucket each class has for itself, packed by ranges of the classes.

    A class can have some in every bucket: as rows they would be as many as classes times buckets.
    """

    def run(table: pa.Table) -> pa.Table:
        release()
        keys, owners = [], []
        for several, x, y in zip(table["pairs"].to_pylist(), table["x"].to_pylist(), table["y"].to_pylist()):
            keys.append(np.frombuffer(x, U))
            owners.append(np.zeros(len(keys[-1]), np.int64) if several else np.frombuffer(y, np.int64))
            if several:  # twice: never alone
                keys.append(keys[-1])
                owners.append(owners[-1])
        k, o = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(k)
        k, o = k[order], o[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        mine, n = np.unique(o[at[np.diff(np.append(at, len(k))) == 1]].view(U), return_counts=True)
        ends = np.concatenate([[0], np.searchsorted(mine, _cuts(buckets)), [len(mine)]])
        rows = [(i, binary(mine[a:b]), binary(n[a:b].astype(np.int64))) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
        columns = list(zip(*rows)) or [[]] * 3
        return pa.table({c: pa.array(list(v), t) for c, v, t in zip(("part", "x", "y"), columns, (pa.int32(), pa.binary(), pa.binary()))})

    return run


def _alone_sums(table: pa.Table) -> pa.Table:
    """The counts of all buckets added up, for one range of the classes."""
    release()
    classes, n = (np.concatenate([np.frombuffer(b, np.int64) for b in table[c].to_pylist()]) for c in "xy")
    order = np.argsort(classes)
    classes, n = classes[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    return pa.table({"fp": classes[at], "alone": np.add.reduceat(n, at)})


def _reach(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(fp, n, low, high): the sizes that a partner of a class can have.

    Shingles that no other proposed class has are in no intersection, so a class with many of them has no partner at
    all, or none as large as itself. This is what keeps a large group of copies that differ too much from being
    compared pair by pair.
    """
    n = slices(sets.sparkSession)
    packed = sets.select("fp", "shingles").mapInArrow(_alone_keys(n), "bucket int, pairs boolean, x binary, y binary")
    counts = packed.groupBy("bucket").applyInArrow(_alone(n), "part int, x binary, y binary")
    alone = counts.groupBy("part").applyInArrow(_alone_sums, "fp bigint, alone bigint")
    sized = sets.select("fp", F.size("shingles").cast("long").alias("n")).join(alone, "fp", "left")
    shared = f"(n - coalesce(alone, 0)) * {num + den} div {num} - n"
    return sized.selectExpr("fp", "n", f"(n * {num} + {den - 1}) div {den} AS low", f"least(n * {den} div {num}, {shared}) AS high")


def row_key(*columns: str) -> Column:
    """A key of whole rows: rows that share it are repeated ones, with equal results."""
    return F.xxhash64(*columns)


def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar enough, by their whole sets."""
    one = pairs.join(sets.selectExpr("fp AS a", "shingles AS left"), "a").join(sets.selectExpr("fp AS b", "shingles AS right"), "b")
    common = one.select("a", "b", F.size(F.array_intersect("left", "right")).cast("long").alias("i"), (F.size("left") + F.size("right")).cast("long").alias("t"))
    return common.where(f"{den} * i >= {num} * (t - i)").select("a", "b")


def link_components(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_key, doc_id, n_shingles, component_id) of every row; links are similarities of num / den or more."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.select(row_key("doc_id", "text").alias("doc_key"), "doc_id", "text")
    meta = materialise(keyed.mapInArrow(_meta(width), "doc_key bigint, doc_id bigint, n bigint, fp bigint"), "shingle-meta")

    packed = rows.select("text").mapInArrow(_sign(width, num, den, BUCKETS * slices(spark)), "bucket int, pairs boolean, x binary, y binary")
    met = packed.groupBy("bucket").applyInArrow(_meet, "a bigint, b bigint, n bigint, open boolean")
    # all of them, whatever their sizes: a star edge between sets that cannot be similar still leads to those that can
    proposed = materialise(met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("open").alias("open")), "proposed")
    sizes = meta.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_key").alias("doc_key"))

    classes = proposed.selectExpr("a AS fp").unionByName(proposed.selectExpr("b AS fp")).distinct()
    wanted = sizes.join(classes, "fp").select("doc_key", "fp")
    bodies = keyed.select("doc_key", "text").mapInArrow(packed_texts, "doc_key bigint, body binary")
    texts = bodies.join(wanted, "doc_key").select("fp", "body")
    sets = materialise(texts.mapInArrow(_set_rows(width), "fp bigint, shingles array<bigint>").dropDuplicates(["fp"]), "shingle-sets")

    reach = materialise(_reach(sets, num, den), "reach")
    ra, rb = (reach.selectExpr(f"fp AS {c}", f"n AS n{c}", f"low AS l{c}", f"high AS h{c}") for c in "ab")
    fit = "nb BETWEEN la AND ha AND na BETWEEN lb AND hb"
    fitting = materialise(proposed.join(ra, "a").join(rb, "b").where(fit).select("a", "b", "n"), "fitting")

    links = materialise(_checked(fitting, sets, num, den), "links")
    labels = components(links)
    # a pair that is still apart has failed its check: members of its open signatures can be linked past it
    stars = proposed.where("open").select("a", "b", "n")
    third = materialise(_checked(_past_failures(stars, labels, reach, sets, num, den).join(fitting, ["a", "b"], "left_anti"), sets, num, den), "links")
    labels = components(links.unionByName(third))

    classed = meta.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "doc_key", "doc_id", "n", F.coalesce("label", "fp").alias("class")
    )
    names = classed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return classed.join(names, "class", "left").select(
        "doc_key", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _past_failures(proposed: DataFrame, labels: DataFrame, reach: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components that can be similar though no proposal joins them.

    Similar classes that no proposal joins share an open signature, so proposals of open ones (``proposed``) connect
    them, passed, failed or of sizes that do not fit. Those that a few classes share connect nothing here: they would
    chain what is unlike into one group that grows with the table. Each such group has a centre, the class with most proposals, and a class is its difference from it: two classes differ in as
    much as their differences do. Those near the centre are linked by it. A class y further away, with d(y) different shingles, can
    be similar to x with d(x) <= d(y) only if (d(x) + d(y) - k) / 2 of these are common, k being the most that
    similar sets of their sizes differ in. So they share one of the first few of either in the order from rare to
    common, and large groups of copies that differ too much are told apart by their rarest changes.
    """
    rate = f"{den - num} div {den + num}"
    groups = components(proposed).selectExpr("node AS fp", "label AS grp")
    weight = proposed.selectExpr("a AS fp", "n").unionByName(proposed.selectExpr("b AS fp", "n")).groupBy("fp").agg(F.sum("n").alias("w"))
    centres = groups.join(weight, "fp").groupBy("grp").agg(F.max(F.struct("w", "fp")).alias("m")).select("grp", F.col("m.fp").alias("centre"))
    members = materialise(_labelled(groups.select("fp"), labels).join(groups, "fp").join(reach.where("low <= high"), "fp"), "members")
    mixed = members.groupBy("grp").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other").select("grp")
    around = members.join(mixed, "grp").join(centres, "grp").join(sets, "fp").join(sets.selectExpr("fp AS centre", "shingles AS core"), "centre")
    changes = around.selectExpr(
        "fp", "grp", "centre", "label", "n", "low", "high", "size(core) AS nc", "array_except(shingles, core) AS own", "array_intersect(shingles, core) AS held"
    ).withColumn("d", F.expr("size(own) + nc - size(held)"))
    changes = materialise(changes, "changes")
    sized = changes.drop("own", "held").selectExpr("*", f"(n + n * {den} div {num}) * {rate} AS most", f"(n + nc) * {rate} AS reach_c")
    sized = sized.selectExpr(
        "*", "d > reach_c AS far",
        f"CASE WHEN d > reach_c THEN most div 2 + 1 ELSE least(most div 2, (d + greatest(n - nc, 0) * {rate} + 1) div 2) + 1 END AS px",
    ).withColumn("upto", F.expr("int(greatest(px, CASE WHEN far THEN most + 1 ELSE 0 END))"))
    first = materialise(
        sized.join(_ordered(changes, sized, centres.join(mixed, "grp"), sets), "fp").select(
            "fp", "grp", "label", "n", "low", "high", "d", "far", "px", F.posexplode(F.slice("change", F.lit(1), F.col("upto"))).alias("at", "c"),
        ).where("c.f > 1").selectExpr("* EXCEPT (at, c)", "at + 1 AS place", "c.e AS e"),
        "first-changes",
    )
    names = ["fp", "label", "n", "low", "high", "d", "place"]
    x = first.where("place <= px").select("grp", "e", *[F.col(c).alias(f"x_{c}") for c in names])
    y = first.where("far").select("grp", "e", *[F.col(c).alias(f"y_{c}") for c in names])
    k = f"((x_n + y_n) * {rate})"
    able = (
        "x_label <> y_label AND (x_d < y_d OR x_d = y_d AND x_fp < y_fp) AND x_n BETWEEN y_low AND y_high AND y_n BETWEEN x_low AND x_high "
        f"AND y_d - x_d <= {k} AND x_place <= (x_d - y_d + {k}) div 2 + 1 AND y_place <= (y_d - x_d + {k}) div 2 + 1"
    )
    pairs = x.join(y, ["grp", "e"]).where(able).selectExpr("least(x_fp, y_fp) AS a", "greatest(x_fp, y_fp) AS b")
    near = sized.where("NOT far AND fp <> centre").selectExpr("least(fp, centre) AS a", "greatest(fp, centre) AS b")
    return pairs.unionByName(near).distinct()


def _ordered(changes: DataFrame, sized: DataFrame, centres: DataFrame, sets: DataFrame) -> DataFrame:
    """(fp, change): the differences of a class from its centre from rare to common, whole in its first ``upto``.

    What classes lack of a centre can be many times what they hold themselves, and almost all of it is common. It is
    counted by those that hold it, put in order once for each centre, and a class takes the first it lacks: no more
    rows are made than there are shingles in the sets.
    """
    extra = changes.select("fp", "grp", F.explode("own").alias("e"))
    common = extra.groupBy("grp", "e").agg(F.count(F.lit(1)).alias("f"))
    holders = changes.select("grp", F.explode("held").alias("e")).groupBy("grp", "e").agg(F.count(F.lit(1)).alias("h"))
    core = centres.join(sets.selectExpr("fp AS centre", "shingles"), "centre").select("grp", F.explode("shingles").alias("e"))
    lacking = core.join(holders, ["grp", "e"], "left").join(changes.groupBy("grp").agg(F.count(F.lit(1)).alias("m")), "grp")
    lacking = materialise(lacking.selectExpr("grp", "e", "m - coalesce(h, 0) AS f").where("f > 0"), "lacking")
    # written, so that a large group can be dealt to several tasks in the join
    order = materialise(lacking.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("core")), "order")
    held = changes.select("fp", "grp", "held").join(sized.select("fp", "upto"), "fp").join(order, "grp")
    lacked = held.select("fp", "grp", F.explode(F.expr("slice(array_except(core.e, held), 1, upto)")).alias("e"))
    found = extra.join(common, ["grp", "e"]).unionByName(lacked.join(lacking, ["grp", "e"]))
    return found.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("change"))


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` (fp) with the label of their component, or their own."""
    return nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
