"""Matching of predicted to true spans within one sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

MIN_IOU = 0.5
PAIR_DDL = "struct<i:int,j:int,iou:double>"
NEAR_DDL = "struct<i:int,near:array<struct<loss:double,j:int>>>"


def iou(a: Column, b: Column) -> Column:
    """Shared length over the length of the hull."""
    shared = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.when(hull > 0, shared / hull).otherwise(F.lit(0.0))


def _starts_before(truth: Column, pred: Column, bound) -> Column:
    """For each prediction, in order, how many true spans (sorted by start) begin before ``bound`` of it.

    Bounds and starts are sorted together; a bound at place x with k other bounds before it has x - k starts before it.
    """
    marks = F.transform(pred, lambda p, r: F.struct(bound(p).cast("long").alias("at"), F.lit(0).alias("side"), r.alias("r")))
    starts = F.transform(truth, lambda t: F.struct(t["start"].cast("long").alias("at"), F.lit(1).alias("side"), F.lit(-1).alias("r")))
    placed = F.transform(F.sort_array(F.concat(marks, starts)), lambda m, x: F.struct(m["r"].alias("r"), x.alias("x")))
    counts = F.transform(F.filter(placed, lambda m: m["r"] >= 0), lambda m, k: F.struct(m["r"].alias("r"), (m["x"] - k).alias("n")))
    return F.transform(F.sort_array(counts), lambda c: c["n"])


def _near(pred: Column, truth: Column) -> Column:
    """Each prediction with the true spans that overlap it by at least one half, best first.

    Such a span starts before the prediction ends and at most the prediction's length before it starts, so it lies in a
    short slice of the true spans sorted by start: the work is linear in spans and overlaps.
    """

    def sliced(b: Column) -> Column:
        def one(p, r):
            first, behind = F.get(b["low"], r), F.get(b["high"], r)
            some = F.slice(truth, first + 1, F.greatest(behind - first, F.lit(0)))
            scored = F.transform(some, lambda t: F.struct((-iou(p, t)).alias("loss"), t["j"].alias("j")))
            near = F.sort_array(F.filter(scored, lambda s: s["loss"] <= -MIN_IOU))
            return F.struct(p["i"].alias("i"), near.alias("near"))

        return F.transform(pred, one)

    low = _starts_before(truth, pred, lambda p: 2 * p["start"] - p["end"])
    high = _starts_before(truth, pred, lambda p: p["end"])
    return let(F.struct(low.alias("low"), high.alias("high")), sliced)


def _folded(near: Column, truths: Column) -> Column:
    """Pairs in the order of ``near``; each takes its best true span that is still free."""
    one = F.lit(1).cast("long")
    free = F.array_repeat(F.lit(0).cast("long"), F.ceil(truths / 64).cast("int"))
    no_pairs = F.array().cast(f"array<{PAIR_DDL}>")
    width = F.ceil(F.sqrt(F.size(near))).cast("int")
    chunks = F.when(
        F.size(near) > 0,
        F.transform(F.sequence(F.lit(0), ((F.size(near) - 1) / width).cast("int")), lambda c: F.slice(near, c * width + 1, width)),
    ).otherwise(F.array().cast(f"array<array<{NEAR_DDL}>>"))

    def is_free(used, j):
        return F.call_function("shiftright", F.get(used, (j / 64).cast("int")), j % 64).bitwiseAND(one) == 0

    def taken(used, j):
        bit = F.call_function("shiftleft", one, j % 64)
        return F.transform(used, lambda w, x: F.when(x == (j / 64).cast("int"), w.bitwiseOR(bit)).otherwise(w))

    def step(acc, p):
        best = F.get(F.filter(p["near"], lambda s: is_free(acc["used"], s["j"])), F.lit(0))

        def done(b):
            pair = F.struct(p["i"].alias("i"), F.coalesce(b["j"], F.lit(-1)).alias("j"), F.coalesce(-b["loss"], F.lit(0.0)).alias("iou"))
            used = F.when(b.isNull(), acc["used"]).otherwise(taken(acc["used"], b["j"]))
            return F.struct(used.alias("used"), F.concat(acc["out"], F.array(pair)).alias("out"))

        return let(best, done)

    def chunk_step(acc, chunk):
        inner = F.aggregate(chunk, F.struct(acc["used"].alias("used"), no_pairs.alias("out")), step)
        return let(inner, lambda i: F.struct(i["used"].alias("used"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    start = F.struct(free.alias("used"), F.array().cast(f"array<array<{PAIR_DDL}>>").alias("out"))
    return F.aggregate(chunks, start, chunk_step, lambda acc: F.flatten(acc["out"]))


def greedy_pairs(pred: Column, truth: Column) -> Column:
    """array<struct<i,j,iou>>: each prediction by falling score, ``j = -1`` where unmatched.

    A prediction takes the unused true span with the largest overlap of at least one half;
    the label plays no part, and the first of equals wins. Used spans are bits of an array of longs, and predictions are
    folded in chunks of about the square root of their number, so no long array is copied at each step.
    """
    order = F.sort_array(
        F.transform(
            pred,
            lambda p, i: F.struct(
                (-F.coalesce(p["score"], F.lit(0.0))).alias("k"), i.alias("i"), p["start"].alias("start"), p["end"].alias("end"),
            ),
        )
    )
    gold = F.sort_array(F.transform(truth, lambda t, j: F.struct(t["start"].alias("start"), j.alias("j"), t["end"].alias("end"))))
    sides = F.struct(order.alias("pred"), gold.alias("truth"))
    return let(sides, lambda s: let(_near(s["pred"], s["truth"]), lambda near: _folded(near, F.size(s["truth"]))))


def painted(entities: Column, at: Column) -> Column:
    """Label of the last span covering the character ``at``; ``O`` outside all spans."""
    cover = F.filter(entities, lambda e: (e["start"] <= at) & (at < e["end"]))
    return F.coalesce(F.try_element_at(cover, F.lit(-1))["label"], F.lit("O"))


def agreeing_chars(chars: Column, truth: Column, pred: Column) -> Column:
    """Characters that carry the same label on both sides.

    Labels change only at span borders, so one comparison per stretch between borders is enough.
    """

    def edges(entities, field):
        return F.transform(
            entities, lambda e: F.least(F.greatest(e[field], F.lit(0)), chars)
        )

    borders = F.sort_array(
        F.array_distinct(
            F.concat(
                F.array(F.lit(0), chars),
                edges(truth, "start"), edges(truth, "end"),
                edges(pred, "start"), edges(pred, "end"),
            )
        )
    )
    stretches = F.zip_with(
        borders,
        F.slice(borders, F.lit(2), F.greatest(F.size(borders) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    return F.aggregate(
        stretches,
        F.lit(0).cast("long"),
        lambda acc, s: acc
        + F.when(
            s["b"].isNotNull() & (painted(truth, s["a"]) == painted(pred, s["a"])),
            (s["b"] - s["a"]).cast("long"),
        ).otherwise(F.lit(0).cast("long")),
    )
