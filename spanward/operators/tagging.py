"""Token tags, label vocabulary and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import pii
from ..functions.regex import jvm_pattern
from ..functions.spans import flatten, raw_spans
from ..session import small_table
from .detect import canonical

TOKEN = r"\w+|[^\w\s]"
IGNORED = -100
WEIGHT_CAP = 10.0
FIXED_OUTSIDE_WEIGHT = 0.1


def squeezed(label: Column) -> Column:
    return F.translate(F.upper(label), "_ ", "")


def _pairs(vocab: DataFrame) -> DataFrame:
    """(b_id, i_id, suffix) of labels that have both tags; bounded by the vocabulary."""
    begin = vocab.filter(F.col("tag").startswith("B-")).select(
        F.col("id").alias("b_id"), F.substring("tag", 3, 1 << 20).alias("suffix")
    )
    inside = vocab.filter(F.col("tag").startswith("I-")).groupBy(
        F.substring("tag", 3, 1 << 20).alias("suffix")
    ).agg(F.min("id").alias("i_id"))
    return begin.join(inside, "suffix")


def with_label_ids(rows: DataFrame, vocab: DataFrame, custom: list[str] = ()) -> DataFrame:
    """Add b_id and i_id to rows with a label: by canonical name, else by squeezed name; lowest id wins.

    Both look-ups are as small as the vocabulary; how they are joined is left to the optimizer.
    """
    pairs = _pairs(vocab)
    by_name = pairs.groupBy(canonical("suffix", custom).alias("label")).agg(
        F.min(F.struct("b_id", "i_id")).alias("_named")
    )
    by_suffix = pairs.groupBy(squeezed(F.col("suffix")).alias("_key")).agg(
        F.min(F.struct("b_id", "i_id")).alias("_exact")
    )
    return (
        rows.withColumn("_key", squeezed(F.col("label")))
        .join(by_name, "label", "left")
        .join(by_suffix, "_key", "left")
        .withColumns({c: F.coalesce(f"_named.{c}", f"_exact.{c}") for c in ("b_id", "i_id")})
        .drop("_key", "_named", "_exact")
    )


def dataset_labels(samples: DataFrame) -> DataFrame:
    """Distinct labels as they are in the data, with the trimmed lower-case name."""
    return flatten(samples, "entities.label", "label").select(
        F.lower(F.trim("label")).alias("label")
    ).distinct()


def grow_vocab(samples: DataFrame, vocab: DataFrame, custom: list[str] = ()) -> DataFrame:
    """Vocabulary with B- and I- tags appended, in alphabetical order, for labels without them."""
    ids = with_label_ids(dataset_labels(samples), vocab, custom)
    suffix = F.replace(F.upper("label"), F.lit(" "), F.lit("_"))
    wanted = (
        ids.filter("b_id IS NULL OR i_id IS NULL")
        .select("label", F.posexplode(F.array(F.concat(F.lit("B-"), suffix), F.concat(F.lit("I-"), suffix))).alias("k", "tag"))
        .join(vocab.select("tag"), "tag", "left_anti")
        .dropDuplicates(["tag"])
    )
    # one partition on purpose: a label vocabulary, not data; known tags come first, so a new one's place is its id
    known = vocab.select("id", "tag", F.lit(0).alias("new"), F.lit("").alias("label"), F.lit(0).alias("k"))
    both = known.unionByName(wanted.select(F.lit(None).cast("int").alias("id"), "tag", F.lit(1).alias("new"), "label", "k"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("new", "label", "k")) - 1
    return both.select(F.coalesce("id", place).cast("int").alias("id"), "tag")


def tokens_of(samples: DataFrame, *keep: str, features: str | None = None) -> DataFrame:
    """One row per token: kept columns, pos, t (start, end, value) and, if asked for, f.

    ``features`` is an expression over the text's token array ``_t`` that gives one element per
    token, so what depends on neighbouring tokens needs no window.
    """
    rows = samples.select(*keep, raw_spans("text", TOKEN).alias("_t"))
    if features is None:
        return flatten(rows, "_t", "t", *keep, pos="pos")
    rows = rows.select(*keep, "_t", F.expr(features).alias("_f"))
    zipped = flatten(rows, F.arrays_zip("_t", "_f"), "z", *keep, pos="pos")
    return zipped.select(*keep, "pos", F.col("z._t").alias("t"), F.col("z._f").alias("f"))


def tagged_tokens(samples: DataFrame, features: str | None = None) -> DataFrame:
    """(sample_id, pos, start, end, token, label, begins): first span in list order that holds it."""
    tokens = tokens_of(samples, "sample_id", "entities", features=features)
    inside = F.try_element_at(
        F.filter("entities", lambda e: (F.col("t.start") >= e["start"]) & (F.col("t.end") <= e["end"])), F.lit(1)
    )
    extra = [] if features is None else [F.col("f").alias("features")]
    return tokens.withColumn("_e", inside).select(
        "sample_id", "pos", "t.start", "t.end", F.col("t.value").alias("token"),
        F.col("_e.label").alias("label"),
        (F.col("_e.start") == F.col("t.start")).alias("begins"),
        *extra,
    )


def bio_tag(
    samples: DataFrame, vocab: DataFrame, custom: list[str] = (), features: str | None = None
) -> DataFrame:
    """Tokens with tag_id: B at a span's start, I inside, 0 outside, -100 for empty tokens."""
    joined = with_label_ids(tagged_tokens(samples, features), vocab, custom)
    tag = (
        F.when(F.col("start") == F.col("end"), IGNORED)
        .when(F.col("label").isNull(), 0)
        .when(F.col("begins"), F.coalesce("b_id", "i_id", F.lit(0)))
        .otherwise(F.coalesce("i_id", "b_id", F.lit(0)))
    )
    extra = [] if features is None else ["features"]
    return joined.select("sample_id", "pos", "start", "end", "token", "label", tag.cast("int").alias("tag_id"), *extra)


def class_weights(tags: DataFrame, vocab: DataFrame, mode: str = "balanced") -> DataFrame:
    """(id, tag, count, weight).

    ``balanced``: total / (classes * count), 1 for classes not seen, relative to class 0, at
    most ten. ``fixed``: a tenth for ``O``, 1 otherwise.
    """
    counts = tags.filter(F.col("tag_id") != IGNORED).groupBy(F.col("tag_id").alias("id")).agg(
        F.count(F.lit(1)).alias("count")
    )
    rows = vocab.join(counts, "id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    if mode == "fixed":
        weight = F.when(F.col("tag") == "O", FIXED_OUTSIDE_WEIGHT).otherwise(1.0)
        return rows.select("id", "tag", "count", weight.alias("weight"))
    # windows over the vocabulary, a few hundred rows
    everything = Window.partitionBy(F.lit(0))
    total, classes = F.sum("count").over(everything), F.count(F.lit(1)).over(everything)
    raw = F.when(F.col("count") > 0, total / (classes * F.col("count"))).otherwise(1.0)
    rows = rows.withColumn("_w", raw)
    outside = F.max(F.when(F.col("id") == 0, F.col("_w"))).over(everything)
    scaled = F.when(outside > 0, F.col("_w") / outside).otherwise(F.col("_w"))
    return rows.select("id", "tag", "count", F.least(scaled, F.lit(WEIGHT_CAP)).alias("weight"))


def vocab_labels(vocab: DataFrame, saved: list[str] = ()) -> DataFrame:
    """(label, is_custom): canonical labels of a vocabulary and the saved custom ones."""
    spark = vocab.sparkSession
    own = vocab.filter(F.col("tag") != "O").select("id", "tag")
    custom_tags = own.filter(F.col("id") >= pii.FIRST_CUSTOM_LABEL_ID)
    bare = F.when(F.col("tag").startswith("B-") | F.col("tag").startswith("I-"), F.substring("tag", 3, 1 << 20)).otherwise(F.col("tag"))
    keys = custom_tags.select(squeezed(bare).alias("key")).distinct().withColumn("_own", F.lit(True))
    named = own.withColumn("key", squeezed(bare)).join(keys, "key", "left").select(
        F.when(F.col("_own"), F.replace(F.lower(bare), F.lit("_"), F.lit(" "))).otherwise(canonical("tag")).alias("label"),
        (F.col("id") >= pii.FIRST_CUSTOM_LABEL_ID).alias("is_custom"),
    )
    extra = small_table(spark, [(s, True) for s in saved], "label string, is_custom boolean")
    return named.unionByName(extra).groupBy("label").agg(F.max("is_custom").alias("is_custom"))


def curve_summary(history: DataFrame) -> DataFrame:
    """Per run: steps, first and last loss, percent reduction, last learning rate."""
    logged = history.filter(F.col("loss").isNotNull())
    first, last = F.min_by("loss", "step"), F.max_by("loss", "step")
    return logged.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps"),
        first.alias("first_loss"),
        last.alias("last_loss"),
        F.when(first > 0, (first - last) / first * 100.0).otherwise(0.0).alias("reduction_percent"),
        F.coalesce(F.max_by("learning_rate", "step"), F.lit(1e-4)).alias("last_learning_rate"),
    )
