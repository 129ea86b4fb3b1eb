"""Texts of a test set that are too similar to a training text.

An exact set-similarity join over posting lists. Tokens of the test set are ordered by how many test texts hold them; two
sets above the threshold share a token among the first few of the test text, its prefix. A training text sends a token
only if it may be in some prefix, which a bitmap of bounded size tells before anything is shuffled; candidates alone are
compared in full, by their tokens.

Posting lists of tokens with more than a ten-thousandth of all postings are dealt over shards by the training text's
id, and the test postings of such a token are repeated for each shard: there are at most ten thousand of them, which
bounds what is broadcast. Copies among test texts count once, and training texts are taken in growing blocks: as only the
first match of a test text is asked for, a test text leaves as soon as it has one, so that a large group of near-copies
on both sides never meets in full.

Posting lists grow with the texts on both sides, and what they join to with the product. From a threshold of ``SIGNED``
on, texts are dealt to cells by size and block instead, with a signature and their rarest tokens as 32-bit marks, on both
sides only as many as a text has to show to one of that size. A cell joins the marks of its two blocks in memory; only
pairs with enough marks in common compare their signatures, and only pairs left in doubt leave the cell. A signature is a
parity bitmap of four to eight bits a token, and two of them differ in no more bits than the sets in tokens, which bounds
the overlap from above. Marks that meet more often than there are pairs are not joined; then all signatures are compared.
Cells are filled in waves, so that the copies which blocks of the one side need of the other never lie on disk at once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.factory import LEAKAGE_JACCARD
from ..functions.members import bitmap, maybe_members
from ..functions.regex import NOT_SPACE, words
from ..functions.scale import SLICE, sliced
from ..functions.spans import flatten, let
from ..session import materialise, slices, small_table

#: Shares of the training slices that each block ends at.
BLOCKS = (1 / 64, 1 / 8, 1.0)
#: A token is hot beyond this share of all postings, so no more tokens than its inverse can be.
HOT_SHARE = 1 / 10_000
#: Signatures tell texts apart from this threshold on.
SIGNED = 0.4
#: Texts of each side that a cell compares, fewer if they have more tokens than ``CELL_TOKENS``.
CELL_ROWS, CELL_TOKENS = 32768, 256
#: What is dealt to cells at once, in bytes.
WAVE = 2_000_000_000
#: Cells of tokens whose texts are counted together, to tell rare from common ones.
COUNTED = 1 << 20
#: Marks beyond one that two texts of many tokens must share; each needs one more to be shown.
EXTRA = 4
#: Meetings of marks that a cell holds at once.
MEETINGS = 1 << 21


def token_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def _sets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, tokens, n) of texts with tokens.

    Filters look at the text and never at tokens: the optimizer would push them, and the cutting into tokens with them,
    below joins and ahead of any dealing out of rows.
    """
    rows = df.where(F.col(text).rlike(NOT_SPACE)).select(F.col(id_col).alias("id"), token_set(F.col(text)).alias("tokens"))
    return rows.withColumn("n", F.size("tokens"))


def signature(tokens: Column) -> Column:
    """binary: the parity of the number of tokens in each cell; 16 to 256 words of 64 cells, by the number of tokens."""

    def run(hashes: pa.Array) -> pa.Array:
        out = []
        for one in hashes:
            if not one.is_valid:
                out.append(None)
                continue
            h = one.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            words = min(256, max(16, 1 << (len(h) // 16).bit_length()))
            cell = h % np.uint64(words * 64)
            bits = np.zeros(words, dtype=np.uint64)
            np.bitwise_xor.at(bits, (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
            out.append(bits.tobytes())
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(F.transform(tokens, lambda t: F.xxhash64(t)))


def maybe_similar(a: Column, b: Column, total: Column, threshold: float) -> Column:
    """False only where two signatures rule out a similarity above the threshold; ``total``: tokens of both sets."""

    def run(left: pa.Array, right: pa.Array, totals: pa.Array) -> pa.Array:
        out = []
        for x, y, n in zip(left.to_pylist(), right.to_pylist(), totals.to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            while len(x) != len(y):  # the halves of a bitmap, xored, are the bitmap of half the cells
                x, y = (x, y) if len(x) > len(y) else (y, x)
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            overlap = (n - int(np.bitwise_count(x ^ y).sum())) / 2
            out.append(overlap > threshold * (n - overlap) - 1e-9)
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(a, b, total)


def plausible(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The (test_id, train_id) whose sizes and signatures leave them in doubt; both sides: (id, n, sig)."""
    a = left.select(F.col("id").alias("test_id"), F.col("n").alias("_n"), F.col("sig").alias("_a"))
    b = right.select(F.col("id").alias("train_id"), F.col("n").alias("_m"), F.col("sig").alias("_b"))
    met = pairs.join(a, "test_id").join(b, "train_id")
    sizes = (F.col("_m") >= F.col("_n") * threshold - 1e-9) & (F.col("_m") <= F.col("_n") / threshold + 1e-9)
    near = met.where(sizes).where(maybe_similar(F.col("_a"), F.col("_b"), F.col("_n") + F.col("_m"), threshold))
    return materialise(near.select("test_id", "train_id"), "plausible")


def token_counts(sets: DataFrame) -> np.ndarray:
    """For each of ``COUNTED`` cells of tokens, how often texts hold one of them, in sixths of a power of two."""
    cells = sets.select(F.explode(F.transform("tokens", lambda t: F.xxhash64(t))).alias("h")).select(F.pmod("h", F.lit(COUNTED)).cast("int").alias("cell"))
    some = cells.groupBy("cell").agg(F.round(F.log2(F.count(F.lit(1)) + 1) * 6).cast("smallint").alias("c")).toArrow()
    out = np.zeros(COUNTED, np.uint8)
    out[some["cell"].to_numpy()] = np.minimum(some["c"].to_numpy(), 255)
    return out


def rare_marks(tokens: Column, counts: np.ndarray, threshold: float) -> Column:
    """binary: 32 bits each of the rarest tokens in ascending order, as many as a text of any size can ask for.

    The order is of 64-bit hashes, one for all texts, so that equal tokens are in equal order; cells and marks may be
    shared by unequal tokens, which only adds to what two texts seem to have in common.
    """

    def run(hashes: pa.Array) -> pa.Array:
        out = []
        for one in hashes:
            if not one.is_valid:
                out.append(None)
                continue
            h = one.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            order = (counts[h % np.uint64(COUNTED)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
            kept = np.argsort(order)[: len(h) - math.floor(len(h) * threshold - 1e-9) + EXTRA]
            out.append((h[kept] >> np.uint64(32)).astype(np.uint32).tobytes())
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(F.transform(tokens, lambda t: F.xxhash64(t)))


def _prefix_length(n: Column, threshold: float) -> Column:
    return n - F.floor(n * threshold).cast("int")


def token_sets(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, tokens, n) of texts with tokens, written once; what ``leakage`` and others take as ``sets``."""
    return materialise(_sets(df, id_col, text), "token-sets")


def leakage(
    test: DataFrame,
    train: DataFrame,
    test_id: str,
    train_id: str,
    test_text: str = "text",
    train_text: str = "text",
    threshold: float = LEAKAGE_JACCARD,
    sets: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(test_id, train_id, overlap): the first training text, by id, above the threshold.

    sets: the ``token_sets`` of both sides, if something else needs them too.
    """
    signed, hot = threshold >= SIGNED, None
    test_sets = sets[0] if sets else token_sets(test, test_id, test_text)
    printed = F.unhex(F.sha2(F.array_join(F.sort_array("tokens"), " "), 256))
    prints = materialise(test_sets.select("id", printed.alias("print")), "test-prints")
    first = prints.groupBy("print").agg(F.min("id").alias("id"))
    known = test_sets.join(first.select("id"), "id", "left_semi")
    bounds = test_sets.agg(F.min("n"), F.max("n")).first()
    low, high = bounds[0] or 0, bounds[1] or 0

    def fits(n: Column) -> Column:
        return (n > low * threshold) & (n * threshold < high)

    if signed:
        train_sets, counts = sets[1] if sets else token_sets(train, train_id, train_text), token_counts(test_sets)

        def marked(sets: DataFrame) -> DataFrame:
            return sets.select("id", "n", signature(F.col("tokens")).alias("sig"), rare_marks(F.col("tokens"), counts, threshold).alias("marks"))

        left = materialise(marked(known), "test-signatures")
        right = materialise(marked(train_sets), "train-signatures").where(fits(F.col("n")))
    else:
        known = materialise(known, "test-first")
        left = materialise(test_postings(known, threshold), "test-postings")
        right = materialise(train_postings(train, train_id, train_text, left, fits), "train-postings")
        hot = materialise(hot_tokens(right), "hot-tokens")

    def members(able: tuple[DataFrame, int]) -> DataFrame:
        if signed:
            return maybe_members(train_sets, F.xxhash64("id"), able)
        texts = train.select(F.col(train_id).alias("id"), F.col(train_text).alias("text"))
        return materialise(_sets(maybe_members(texts, F.xxhash64("id"), able), "id", "text"), "train-sets")

    open_test, found = left, None
    for block in _blocks(right):
        some = right.where(block)
        pairs = materialise(signed_candidates(open_test, some, threshold) if signed else candidates(open_test, some, hot, threshold), "candidates")
        hits = materialise(verified(pairs, test_sets, members, threshold), "matches")
        found = hits if found is None else found.unionByName(hits)
        open_test = open_test.join(hits.select("id"), "id", "left_anti")

    copies = prints.select(F.col("id").alias("copy"), "print")
    firsts = prints.join(found, "id")
    return firsts.drop("id").join(copies, "print").select(
        F.col("copy").alias("test_id"), "train_id", "overlap"
    )


def test_postings(known: DataFrame, threshold: float) -> DataFrame:
    """(token, id, n, rest): the rarest tokens of each test text and how many are left out.

    The regrouping is by text and holds one text's distinct tokens at most.
    """
    tokens = flatten(known, F.transform("tokens", lambda t: F.xxhash64(t)), "token", "id", "n")
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(common, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    prefix = F.slice("ranked", F.lit(1), _prefix_length(F.col("n"), threshold))
    sent = ranked.select("id", "n", (F.col("n") - F.size(prefix)).alias("rest"), F.transform(prefix, lambda r: r["token"]).alias("prefix"))
    return flatten(sent, "prefix", "token", "id", "n", "rest")


def train_postings(train: DataFrame, id_col: str, text: str, lists: DataFrame, fits: Callable[[Column], Column]) -> DataFrame:
    """(token, id, n) of training texts of fitting sizes, for tokens that may be in some test text's prefix."""

    def sent(tokens: Column) -> Column:
        n = F.size(tokens)
        return F.when(fits(n), F.transform(tokens, lambda t: F.struct(F.xxhash64(t).alias("token"), n.alias("n"))))

    rows = flatten(train.select(F.col(id_col).alias("id"), let(token_set(F.col(text)), sent).alias("sent")), "sent", "s", "id")
    return maybe_members(rows.select("s.token", "id", "s.n"), F.col("token"), bitmap(lists, "token"))


def hot_tokens(postings: DataFrame) -> DataFrame:
    """(token, shards) of the tokens with more than ``HOT_SHARE`` of all postings."""
    limit = max(1.0, postings.count() * HOT_SHARE)
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit)
    return counts.select("token", F.ceil(F.col("c") / limit).cast("int").alias("shards"))


def _blocks(postings: DataFrame) -> list[Column]:
    """Conditions on ascending ids of any type, each for a block of slices."""
    ids = sliced(postings.select("id").distinct(), [], ["id"])
    last = {r[SLICE]: r.id for r in ids.groupBy(SLICE).agg(F.max("id").alias("id")).collect()}
    n, begin, out = slices(postings.sparkSession), None, []
    for share in BLOCKS:
        ends = [i for s, i in last.items() if s < math.ceil(n * share)]
        if not ends or (begin is not None and max(ends) == begin):
            continue
        inside = F.col("id") <= F.lit(max(ends))
        out.append(inside if begin is None else inside & (F.col("id") > F.lit(begin)))
        begin = max(ends)
    return out or [F.lit(True)]


def candidates(lists: DataFrame, postings: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """(test_id, train_id) of texts that can be similar enough.

    A pair shares the prefix tokens it was found by and at most the rest of the test text.
    """
    shards = F.coalesce("shards", F.lit(1))
    a = lists.join(F.broadcast(hot), "token", "left").select(
        "token", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), F.col("id").alias("test_id"), F.col("n").alias("test_n"), "rest"
    )
    b = postings.join(F.broadcast(hot), "token", "left").select(
        "token", F.pmod(F.xxhash64("id"), shards).cast("int").alias("shard"), F.col("id").alias("train_id"), F.col("n").alias("train_n")
    )
    need = F.lit(threshold / (1 + threshold)) * (F.col("test_n") + F.col("train_n"))
    able = (F.col("train_n") > F.col("test_n") * threshold) & (F.col("test_n") > F.col("train_n") * threshold)
    pairs = b.join(a, ["token", "shard"]).filter(able).groupBy("test_id", "train_id", "test_n", "train_n", "rest").agg(F.count(F.lit(1)).alias("c"))
    return pairs.filter(F.col("c") + F.col("rest") > need - 1e-9).select("test_id", "train_id")


def signed_candidates(test: DataFrame, train: DataFrame, threshold: float, banded: bool = False) -> DataFrame:
    """(test_id, train_id) whose signatures leave them in doubt; both sides: (id, n, sig) and marks, if there are any.

    marks: of ``rare_marks``, or, where ``banded``, 64-bit keys of which a pair must share one. A band holds texts of
    sizes from one power of two to one and a half, or from there to the next; a row goes to all blocks of the bands of
    sizes near its own.
    """
    spark, kinds = test.sparkSession, (test.schema["id"].dataType.simpleString(), train.schema["id"].dataType.simpleString())
    cell, parts, share = ["p", "q", "i", "j"], slices(spark), threshold / (1 + threshold)
    with_marks = "marks" in test.columns and "marks" in train.columns

    def by_size(df: DataFrame) -> tuple[DataFrame, dict]:
        digits = F.length(F.bin("n"))
        rows = df.withColumn("band", (digits * 2 + F.when(F.col("n") * 2 >= F.pow(F.lit(2), digits - 1) * 3, 1).otherwise(0)).cast("int"))
        weight = F.length("sig") + (F.length("marks") if with_marks else 0)
        found = rows.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum(weight).alias("bytes")).collect()
        return rows, {r.band: r.asDict() | {"blocks": -(-r.c * max(r.high, CELL_TOKENS) // (CELL_ROWS * CELL_TOKENS))} for r in found}  # a few bands

    def near(a: dict, b: dict) -> bool:
        return a["high"] > threshold * b["low"] - 1e-9 and b["high"] > threshold * a["low"] - 1e-9

    def extra(a: dict, b: dict) -> int:
        return 0 if banded else min(EXTRA, int(share * (a["low"] + b["low"])) // 16)

    def dealt(rows: DataFrame, own: dict, other: dict, spans: tuple[dict, dict], mine: tuple, theirs: tuple) -> DataFrame:
        """spans: of each band of both sides, the blocks that take part, from the first to the last."""

        places = [
            (b, own[b]["blocks"], *spans[0][b], o, *spans[1][o], other[o]["low"], extra(own[b], other[o]))
            for b in spans[0] for o in spans[1] if near(own[b], other[o])
        ]  # of a few bands
        kind = "band int, blocks int, begin int, end int, o int, first int, last int, low int, extra int"
        at = rows.join(F.broadcast(small_table(spark, places, kind)), "band").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        at = at.where(F.col("block").between(F.col("begin"), F.col("end")))
        # the marks before these are those that a text of ``low`` tokens, the fewest that it meets, can ask for
        most = F.col("n") - F.floor(share * (F.col("n") + F.greatest(F.col("low").cast("double"), F.col("n") * threshold)) - 1e-9) + F.col("extra")
        marks = F.col("marks") if banded else F.col("marks").substr(F.lit(1), (most * 4).cast("int")) if with_marks else F.lit(None).cast("binary")
        met = F.explode(F.sequence("first", "last")).alias(theirs[1])
        at = at.select(F.col("band").alias(mine[0]), F.col("block").alias(mine[1]), F.col("o").alias(theirs[0]), met, "id", "n", "sig", marks.alias("marks"))
        return at.repartition(parts, *cell)

    def meeting(left: pa.Table, right: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
        """Rows of both sides with ``least`` marks in common or more, in portions; None if that is no shorter than all pairs."""
        kind = np.uint64 if banded else np.uint32

        def postings(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            marks = np.frombuffer(b"".join(t["marks"].to_pylist()), kind)
            rows = np.repeat(np.arange(t.num_rows, dtype=np.int32), pc.binary_length(t["marks"]).to_numpy() // kind().itemsize)
            order = np.argsort(marks)
            return marks[order], rows[order]

        (x, of_x), (y, of_y) = postings(left), postings(right)
        begin = np.searchsorted(y, x)
        count = np.searchsorted(y, x, "right") - begin
        some = count > 0
        begin, count, of_x = begin[some], count[some], of_x[some]
        each = np.bincount(of_x, count, left.num_rows)
        if each.sum() > left.num_rows * right.num_rows and not banded:
            return None

        def portions():
            portion = (np.cumsum(each) // MEETINGS).astype(np.int64)[of_x]
            for k in np.unique(portion):
                b, c, r = (v[portion == k] for v in (begin, count, of_x))
                pairs = np.repeat(r.astype(np.int64) * right.num_rows, c) + of_y[np.arange(c.sum()) + np.repeat(b - np.cumsum(c) + c, c)]
                pairs.sort()
                pairs = pairs[least - 1 :][pairs[least - 1 :] == pairs[: max(0, len(pairs) - least + 1)]]
                yield np.divmod(np.unique(pairs), right.num_rows)

        return portions()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        firsts, seconds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            x, y = (np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint64).reshape(t.num_rows, -1) for t in (left, right))
            while x.shape[1] > y.shape[1]:  # the halves of a bitmap, xored, are the bitmap of half the cells
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            while y.shape[1] > x.shape[1]:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            n, m = left["n"].to_numpy().astype(np.int64), right["n"].to_numpy().astype(np.int64)
            portions = meeting(left, right, 1 + extras[left["p"][0].as_py(), left["q"][0].as_py()]) if with_marks else None
            if portions is None:
                order = np.argsort(m, kind="stable")
                begin, end = np.searchsorted(m[order], n * threshold - 1e-9), np.searchsorted(m[order], n / threshold + 1e-9)
                portions = ((np.full(end[k] - begin[k], k), order[begin[k] : end[k]]) for k in range(len(n)))
            for i, j in portions:
                for at in range(0, len(i), step := max(1, MEETINGS // x.shape[1])):
                    a, b = i[at : at + step], j[at : at + step]
                    total = n[a] + m[b]
                    overlap = (total - np.bitwise_count(x[a] ^ y[b]).sum(axis=1, dtype=np.int64)) / 2
                    hit = (overlap > threshold * (total - overlap) - 1e-9) & (m[b] >= n[a] * threshold - 1e-9) & (m[b] <= n[a] / threshold + 1e-9)
                    firsts.append(a[hit])
                    seconds.append(b[hit])
        taken = left["id"].take(pa.array(np.concatenate(firsts))), right["id"].take(pa.array(np.concatenate(seconds)))
        return pa.table(list(taken), names=["test_id", "train_id"])

    (a, of_a), (b, of_b) = by_size(test), by_size(train)
    if not of_a or not of_b:
        return a.select(F.col("id").alias("test_id")).crossJoin(b.select(F.col("id").alias("train_id"))).limit(0)
    extras = {(p, q): extra(of_a[p], of_b[q]) for p in of_a for q in of_b}
    every = {p: (0, x["blocks"] - 1) for p, x in of_a.items()}
    waves, filled = [{}], 0
    for q, x in of_b.items():
        met = [o for o in of_a.values() if near(o, x)]
        for k in range(x["blocks"]):
            size = x["bytes"] / x["blocks"] * sum(o["blocks"] for o in met) + sum(o["bytes"] for o in met)
            if waves[-1] and filled + size > WAVE:
                waves, filled = [*waves, {}], 0
            filled += size
            waves[-1][q] = (waves[-1].get(q, (k, k))[0], k)
    out = []
    for wave in waves:
        left = dealt(a, of_a, of_b, (every, wave), ("p", "i"), ("q", "j"))
        right = dealt(b, of_b, of_a, (wave, every), ("q", "j"), ("p", "i"))
        met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(compare, f"test_id {kinds[0]}, train_id {kinds[1]}")
        out.append(materialise(met, "wave") if len(waves) > 1 else met)
    return functools.reduce(DataFrame.unionByName, out)


def verified(pairs: DataFrame, test_sets: DataFrame, members: Callable[[tuple[DataFrame, int]], DataFrame], threshold: float) -> DataFrame:
    """(id, train_id, overlap): first match of each test text among ``pairs``.

    members: the training texts' (id, tokens, n), all of a set of ids, given as a bitmap, and maybe some more.
    """
    able = bitmap(pairs.select(F.xxhash64("train_id").alias("key")), "key")
    right = members(able).select(F.col("id").alias("train_id"), F.col("n").alias("rn"), F.col("tokens").alias("rk"))
    met = maybe_members(test_sets, F.xxhash64("id"), bitmap(pairs.select(F.xxhash64("test_id").alias("key")), "key"))
    left = met.select(F.col("id").alias("test_id"), F.col("n").alias("tn"), F.col("tokens").alias("tk"))
    shared = F.size(F.array_intersect("tk", "rk"))
    overlap = let(shared, lambda s: s / (F.col("tn") + F.col("rn") - s))
    compared = materialise(pairs.join(left, "test_id").join(right, "train_id").select("test_id", "train_id", overlap.alias("overlap")), "overlaps")
    return (
        compared.filter(F.col("overlap") > threshold)
        .groupBy("test_id")
        .agg(F.min(F.struct("train_id", "overlap")).alias("m"))
        .select(F.col("test_id").alias("id"), F.col("m.train_id").alias("train_id"), F.col("m.overlap").alias("overlap"))
    )
