"""Evaluation of detectors against true spans.

A sample with its true and predicted spans is one row; matching and painting stay inside it.
The first shuffle is the count per label. ``run_id`` keys any number of runs at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import pii
from ..functions.matching import MIN_IOU, agreeing_chars, greedy_pairs, iou
from ..functions.spans import flatten, name
from .detect import Detector, canonical_sql, detected

EXAMPLES = 5


def eval_set(samples: DataFrame) -> DataFrame:
    return samples.filter((F.size("entities") > 0) & ~F.coalesce("is_hard_negative", F.lit(False)))


def canonical_spans(column: str, custom: list[str] = ()) -> Column:
    label = canonical_sql("e.label", custom)
    return F.expr(
        f"transform({name(column)}, e -> named_struct('label', {label}, 'start', e.start, 'end', e.end, "
        "'score', e.score, 'value', e.value))"
    )


def predict(
    samples: DataFrame, detectors: list[Detector], run_id: str, threshold: float = pii.DEFAULT_THRESHOLD,
    custom: list[str] = (),
) -> DataFrame:
    """(run_id, sample_id, pred): canonical labels, in start order."""
    found = samples.select("sample_id", detected("text", detectors, threshold).alias("_p"))
    return found.select(F.lit(run_id).alias("run_id"), "sample_id", canonical_spans("_p", custom).alias("pred"))


def paired(
    samples: DataFrame, detectors: dict[str, list[Detector]], threshold: float = pii.DEFAULT_THRESHOLD,
    custom: list[str] = (),
) -> DataFrame:
    """Samples with truth and pred, one row per run, without a join: runs share the scan."""
    runs = F.array(
        *[
            F.struct(F.lit(run).alias("run_id"), detected("text", found, threshold).alias("pred"))
            for run, found in detectors.items()
        ]
    )
    rows = samples.withColumns({"truth": canonical_spans("entities", custom), "_runs": runs})
    rows = flatten(rows, "_runs", "_r", "sample_id", "text", "domain", "truth")
    rows = rows.select("_r.run_id", "sample_id", "text", "domain", "truth", F.col("_r.pred").alias("_p"))
    return rows.withColumn("pred", canonical_spans("_p", custom)).drop("_p")


def join_predictions(samples: DataFrame, predictions: DataFrame, custom: list[str] = ()) -> DataFrame:
    """Samples with predictions that are stored in a table."""
    truth = samples.select("sample_id", "text", "domain", canonical_spans("entities", custom).alias("truth"))
    return truth.join(predictions, "sample_id")


def match_spans(pairs: DataFrame) -> DataFrame:
    """Add matched (array of gt, pred, iou), false_positives and false_negatives."""
    out = pairs.withColumn("_m", greedy_pairs(F.col("pred"), F.col("truth")))
    hits = F.filter("_m", lambda m: m["j"] >= 0)
    matched = F.transform(
        hits,
        lambda m: F.struct(
            F.element_at("truth", m["j"] + 1).alias("gt"), F.element_at("pred", m["i"] + 1).alias("pred"),
            m["iou"].alias("iou"),
        ),
    )
    alone = F.sort_array(F.transform(F.filter("_m", lambda m: m["j"] < 0), lambda m: m["i"]))
    fp = F.transform(alone, lambda i: F.element_at("pred", i + 1))
    places = F.when(F.size("truth") > 0, F.sequence(F.lit(0), F.size("truth") - 1)).otherwise(F.array().cast("array<int>"))
    missed = F.array_except(places, F.transform(hits, lambda m: m["j"]))
    fn = F.transform(missed, lambda j: F.element_at("truth", j + 1))
    return out.withColumns({"matched": matched, "false_positives": fp, "false_negatives": fn}).drop("_m")


def _count_row(label, tp=0, fp=0, fn=0, support=0) -> Column:
    return F.struct(
        label.alias("label"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"),
        F.lit(support).alias("support"),
    )


def entity_metrics(matches: DataFrame) -> DataFrame:
    """Per run and label: tp, fp, fn, support, precision, recall, f1."""
    same = F.filter("matched", lambda m: m["gt"]["label"] == m["pred"]["label"])
    other = F.filter("matched", lambda m: m["gt"]["label"] != m["pred"]["label"])
    rows = F.concat(
        F.transform(same, lambda m: _count_row(m["gt"]["label"], tp=1, support=1)),
        F.transform(other, lambda m: _count_row(m["pred"]["label"], fp=1)),
        F.transform(other, lambda m: _count_row(m["gt"]["label"], fn=1, support=1)),
        F.transform("false_positives", lambda e: _count_row(e["label"], fp=1)),
        F.transform("false_negatives", lambda e: _count_row(e["label"], fn=1, support=1)),
    )
    counts = flatten(matches, rows, "c", "run_id").groupBy("run_id", "c.label").agg(
        *[F.sum(f"c.{k}").alias(k) for k in ("tp", "fp", "fn", "support")]
    )
    return counts.select("*", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _rates(tp: Column, fp: Column, fn: Column, prefix: str = "") -> list[Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return [p.alias(f"{prefix}precision"), r.alias(f"{prefix}recall"), f1.alias(f"{prefix}f1")]


def summary_metrics(metrics: DataFrame) -> DataFrame:
    """Per run: micro rates from pooled counts, macro rates as means over its labels."""
    pooled = metrics.groupBy("run_id").agg(
        *[F.sum(c).alias(f"_{c}") for c in ("tp", "fp", "fn")],
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
    )
    micro = _rates(F.col("_tp"), F.col("_fp"), F.col("_fn"), "micro_")
    return pooled.select("run_id", *micro, "macro_precision", "macro_recall", "macro_f1")


def char_accuracy(pairs: DataFrame) -> DataFrame:
    """Per run: share of characters that carry the same label on both sides; 1 without characters."""
    per_sample = pairs.select(
        "run_id",
        F.char_length("text").cast("long").alias("chars"),
        agreeing_chars(F.char_length("text"), F.col("truth"), F.col("pred")).alias("equal"),
    )
    total = per_sample.groupBy("run_id").agg(F.sum("chars").alias("chars"), F.sum("equal").alias("equal"))
    return total.withColumn("accuracy", F.coalesce(F.try_divide(F.col("equal").cast("double"), F.col("chars")), F.lit(1.0)))


def confusion(matches: DataFrame, run_id: str | None = None) -> DataFrame:
    """(run_id, gt_label, pred_label, n) over matched pairs, zero cells included.

    The axis holds every label seen on either side in any run. It is a vocabulary, far smaller
    than the data, and is grouped before the cells are laid out.
    """
    runs = matches if run_id is None else matches.filter(F.col("run_id") == run_id)
    cells = flatten(runs, "matched", "m", "run_id").groupBy(
        "run_id", F.col("m.gt.label").alias("gt_label"), F.col("m.pred.label").alias("pred_label")
    ).agg(F.count(F.lit(1)).alias("n"))
    both = F.concat(F.transform("truth", lambda e: e["label"]), F.transform("pred", lambda e: e["label"]))
    seen = matches.select("run_id", F.explode_outer(F.array_distinct(both)).alias("label")).groupBy("run_id").agg(F.collect_set("label").alias("own"))
    axis = F.sort_array(F.array_distinct(F.flatten(F.collect_list("own").over(Window.partitionBy(F.lit(0))))))  # one row per run
    laid = seen.select("run_id", axis.alias("axis"))
    grid = (
        (laid if run_id is None else laid.filter(F.col("run_id") == run_id))
        .select("run_id", "axis", F.explode("axis").alias("gt_label"))
        .select("run_id", "gt_label", F.explode("axis").alias("pred_label"))
    )
    return grid.join(cells, ["run_id", "gt_label", "pred_label"], "left").fillna(0, ["n"])


def confusion_matrix(cells: DataFrame, labels: list[str]) -> DataFrame:
    """Wide form for known labels."""
    return cells.groupBy("run_id", "gt_label").pivot("pred_label", labels).agg(F.sum("n"))


def error_analysis(matches: DataFrame, base: str, new: str, k: int | None = EXAMPLES) -> DataFrame:
    """(kind, sample_id, pos, domain, text, entity): what the new run fixed and what it broke.

    ``fixed_miss``: a truth the base run missed that some prediction of the new run overlaps.
    ``new_false_positive``: a false positive of the new run that no prediction of the base run
    overlaps. At most ``k`` of each in sample order; None gives all.
    """
    side = ["sample_id", "pred", "false_positives", "false_negatives"]
    old = matches.filter(F.col("run_id") == base).select(
        "sample_id", F.col("pred").alias("base_pred"), F.col("false_negatives").alias("missed")
    )
    now = matches.filter(F.col("run_id") == new).select(*side, "domain", "text").drop("false_negatives")
    both = old.join(now, "sample_id")

    def touched(spans, e):
        return F.exists(spans, lambda p: iou(e, p) >= MIN_IOU)

    def listed(kind, entities):
        return flatten(both, entities, "entity", F.lit(kind).alias("kind"), "sample_id", "domain", "text", pos="pos")

    fixed = listed("fixed_miss", F.filter("missed", lambda e: touched("pred", e)))
    broken = listed("new_false_positive", F.filter("false_positives", lambda e: ~touched("base_pred", e)))
    if k is not None:
        fixed = fixed.orderBy("sample_id", "pos").limit(k)
        broken = broken.orderBy("sample_id", "pos").limit(k)
    return fixed.unionByName(broken)


def compare_runs(metrics: DataFrame, base: str, new: str) -> DataFrame:
    """Per label of either run: rates of both, zero where absent, F1 difference and its sign."""
    cols = ("precision", "recall", "f1", "support")

    def side(run, name):
        return metrics.filter(F.col("run_id") == run).select("label", *[F.col(c).alias(f"{name}_{c}") for c in cols])

    both = side(base, "base").join(side(new, "new"), "label", "full_outer").na.fill(0)
    delta = F.col("new_f1") - F.col("base_f1")
    return both.withColumn("f1_delta", delta).withColumn(
        "change", F.when(delta > 0, "better").when(delta < 0, "worse").otherwise("same")
    )


def compare_summaries(summaries: DataFrame, base: str, new: str, columns: list[str]) -> DataFrame:
    """Difference new - base of each summary column."""
    at = [
        (F.max(F.when(F.col("run_id") == new, F.col(c))) - F.max(F.when(F.col("run_id") == base, F.col(c)))).alias(f"{c}_delta")
        for c in columns
    ]
    return summaries.agg(*at)


def leaderboard(runs: DataFrame, summaries: DataFrame, active: str | None = None) -> DataFrame:
    """Registered runs with macro rates, newest first; not yet evaluated runs keep nulls."""
    macro = summaries.select("run_id", "macro_precision", "macro_recall", "macro_f1")
    flag = F.col("run_id").eqNullSafe(F.lit(active)) if active is not None else F.coalesce("active", F.lit(False))
    return (
        runs.join(macro, "run_id", "left")
        .withColumn("status", F.when(flag, "active").otherwise("inactive"))
        .drop("active")
        .orderBy(F.desc("created_at"), "run_id")
    )
