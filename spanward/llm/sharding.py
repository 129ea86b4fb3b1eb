"""Shards as of one uniform random permutation, with exact sizes, from a hypergeometric communication matrix.

How many rows of each source partition go to each shard is drawn first: a binary tree over the partitions splits the
shards' capacities, each split a multivariate hypergeometric draw, and its leaves are the rows of the matrix. Then
every partition permutes its own rows and deals them out by its row of the matrix, and every shard permutes what it
has got. No row is compared with rows of other partitions before the exchange, shard sizes differ by one at most, and
all draws are functions of the seed and the rows, so a task that runs again gives the same rows.

Only SQL functions are used. A source partition is one split of the input; a shard is numbered in ``BUCKET_ROWS``
pieces of its random order, so that no task holds a shard.

Defined cases: null text has no bytes and checksum 0; equal rows are interchangeable; null ids are ids; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Rows that one task numbers inside a shard, about.
BUCKET_ROWS = 1 << 15
#: Draws look this many standard deviations around the mean; what lies beyond has a chance below 1e-22.
REACH = 10


def _uniform(*parts: str) -> str:
    """In (0, 1), from a hash of the parts."""
    return f"((shiftrightunsigned(xxhash64({', '.join(parts)}), 11) + 0.5) / 9007199254740992D)"


def _draw(good: str, rest: str, n: str, u: str) -> str:
    """SQL for one hypergeometric draw: how many of ``n`` taken from ``good + rest`` are good.

    Walks along the support with the ratio of neighbouring chances, once for the total and once to the place of u.
    """
    total = f"CAST(({good}) + ({rest}) AS DOUBLE)"
    spread = (
        f"CAST({REACH} * sqrt(greatest(({n}) * ({good} / {total}) * ({rest} / {total}) * (({total} - ({n})) / greatest({total} - 1, 1)), 0)) + {REACH} AS BIGINT)"
    )
    mean = f"CAST(({n}) * ({good} / {total}) AS BIGINT)"
    low = f"greatest(({n}) - ({rest}), 0, {mean} - {spread})"
    high = f"least({n}, {good}, {mean} + {spread})"
    ratio = f"CAST(({good}) - x AS DOUBLE) * (({n}) - x) / ((x + 1D) * (({rest}) - ({n}) + x + 1))"
    mass = f"aggregate(sequence({low}, {high}), named_struct('w', 1D, 's', 0D), (a, x) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w), a -> a.s)"
    found = (
        f"aggregate(sequence({low}, {high}), named_struct('w', 1D, 's', {u} * {mass}, 'k', {low}), (a, x) -> named_struct("
        f"'w', a.w * {ratio}, 's', a.s - a.w, 'k', CASE WHEN a.s > 0 THEN x ELSE a.k END), a -> a.k)"
    )
    return f"CASE WHEN ({n}) <= 0 OR ({good}) <= 0 THEN 0L WHEN ({rest}) <= 0 THEN CAST({n} AS BIGINT) ELSE {found} END"


def _split(seed: int, shards: int) -> str:
    """SQL for how much of each capacity in ``caps`` the first ``n_left`` rows of a node take."""
    step = "named_struct('good', caps[j], 'rest', a.rest - caps[j], 'n', a.n, 'out', a.out)"
    drawn = _draw("b.good", "b.rest", "b.n", _uniform(f"{seed}", "node", "j"))
    # nested one-element folds name the intermediate values
    one = (
        f"aggregate(array({step}), CAST(NULL AS STRUCT<rest: BIGINT, n: BIGINT, out: ARRAY<BIGINT>>), (z, b) -> "
        f"aggregate(array({drawn}), CAST(NULL AS STRUCT<rest: BIGINT, n: BIGINT, out: ARRAY<BIGINT>>), (y, k) -> "
        "named_struct('rest', b.rest, 'n', b.n - k, 'out', concat(b.out, array(k)))))"
    )
    first = "named_struct('rest', aggregate(caps, 0L, (s, c) -> s + c), 'n', n_left, 'out', CAST(array() AS ARRAY<BIGINT>))"
    return f"aggregate(sequence(0, {shards - 1}), {first}, (a, j) -> {one}, a -> a.out)"


def communication_matrix(counts: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(source, counts array<long>) from ``counts`` (source, n): rows that each source sends to each shard.

    The tree has one level per doubling of the number of sources.
    """
    spark = counts.sparkSession
    stored = materialise(counts, "shard-counts")
    levels = max(stored.count() - 1, 0).bit_length()
    root = stored.agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("leaves")).where(F.size("leaves") > 0)
    n_all = "aggregate(leaves, 0L, (s, x) -> s + x.n)"
    caps = f"transform(sequence(0, {shards - 1}), j -> {n_all} div {shards} + CASE WHEN j < {n_all} % {shards} THEN 1L ELSE 0L END)"
    nodes = root.selectExpr("1L AS node", "leaves", f"{caps} AS caps")
    for level in range(levels):
        if level and level % 4 == 0:
            nodes = materialise(nodes, "shard-tree")
        halves = nodes.selectExpr(
            "node", "caps", "slice(leaves, 1, CAST(ceil(size(leaves) / 2) AS INT)) AS a",
            "slice(leaves, CAST(ceil(size(leaves) / 2) AS INT) + 1, size(leaves)) AS b",
        ).selectExpr("*", "aggregate(a, 0L, (s, x) -> s + x.n) AS n_left")
        taken = halves.withColumn("taken", F.expr(_split(seed, shards)))
        nodes = taken.selectExpr(
            "inline(array(named_struct('node', 2 * node, 'leaves', a, 'caps', taken), "
            "named_struct('node', 2 * node + 1, 'leaves', b, 'caps', zip_with(caps, taken, (c, t) -> c - t))))"
        ).where(F.size("leaves") > 0)
    return nodes.selectExpr("leaves[0].source AS source", "caps AS counts")


def numbered_in_random_order(rows: DataFrame, group: str, key: str, ties: list[Column], total: int, groups: int, name: str) -> DataFrame:
    """Add ``name``: the place of a row in its group's random order, from 0, without a task that holds a group."""
    buckets = max(1, -(-total // (groups * BUCKET_ROWS)))
    place = (F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53)) * buckets).cast("int")
    cut = rows.withColumn("_bucket", place)
    sizes = cut.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_bucket").orderBy(key, *ties)
    ranked = cut.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [group, "_bucket"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_bucket", "_before", "_in")


def shuffle_into_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.spark_partition_id().alias("source"),
    )
    base = base.withColumns({f"key{i}": F.xxhash64(F.lit(seed + i), "doc_id", "size", "text_crc32") for i in (1, 2)})
    stored = materialise(base, "shard-rows")  # both passes must see the same source partitions
    sources = stored.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    matrix = materialise(communication_matrix(sources, shards, seed), "shard-matrix")
    total = stored.count()
    ties = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    local = stored.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("key1", *ties)))
    ends = matrix.selectExpr("source", "transform(sequence(1, size(counts)), i -> aggregate(slice(counts, 1, i), 0L, (s, x) -> s + x)) AS ends")
    dealt = local.join(ends, "source").withColumn("shard", F.expr("size(filter(ends, e -> e < rank))"))
    rows = dealt.select("doc_id", "size", "text_crc32", "key2", "shard")
    return numbered_in_random_order(rows, "shard", "key2", ties, total, shards, "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )
