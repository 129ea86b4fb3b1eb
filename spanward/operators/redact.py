"""Masking, rewriting and blocking of texts, messages and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import pii
from ..functions.spans import lookup, mask_token, replace_spans
from .detect import Detector, Policy, block_reason, blocked_labels, detected


def substitute(policy: Policy, rewrite_map: dict | None):
    """Text put in place of a span, null where the span stays."""

    def token(e):
        action = policy.action(e["label"])
        rewritten = lookup(e["label"], rewrite_map or {}, mask_token(e["label"]))
        return F.when(action == "MASK", mask_token(e["label"])).when(action == "REWRITE", rewritten)

    return token


def redact(
    df: DataFrame, text: str, policy: Policy, rewrite_map: dict | None = None, entities: str = "entities"
) -> DataFrame:
    """Add clean_text, clean_spans, modified, blocked and reason.

    A span to block wins over everything and leaves the text as it is. Spans to rewrite get
    their generic phrase or, without one, the mask token.
    """
    spans = F.col(entities)
    labels = blocked_labels(spans, policy)
    touched = F.filter(spans, lambda e: policy.action(e["label"]).isin("MASK", "REWRITE"))
    touched = F.when(F.size("_labels") == 0, touched)
    out = df.withColumn("_labels", labels)
    out = out.withColumn(
        "_clean",
        F.when(
            F.size("_labels") == 0,
            replace_spans(F.col(text), touched, substitute(policy, rewrite_map)),
        ),
    )
    clean = F.coalesce(F.col("_clean.text"), F.col(text))
    return out.withColumns(
        {
            "clean_text": clean,
            "clean_spans": F.coalesce(F.col("_clean.spans"), F.slice(spans, 1, 0)),
            "modified": F.coalesce(clean != F.col(text), F.lit(False)),
            "blocked": F.size("_labels") > 0,
            "reason": block_reason(F.col("_labels")),
        }
    ).drop("_labels", "_clean")


def mask(df: DataFrame, text: str, entities: str = "entities") -> DataFrame:
    return redact(df, text, Policy({}, "MASK"), entities=entities)


def guard_texts(
    df: DataFrame,
    text: str,
    detectors: list[Detector],
    policy: Policy,
    rewrite_map: dict | None = None,
    threshold: float = pii.DEFAULT_THRESHOLD,
) -> DataFrame:
    """Detect and redact; also valid on a streaming DataFrame."""
    spans = detected(text, detectors, threshold, policy)
    return redact(df.withColumn("entities", spans), text, policy, rewrite_map)


def _off(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns(
        {
            "clean_text": F.col(text),
            "modified": F.lit(False),
            "blocked": F.lit(False),
            "reason": F.lit(None).cast("string"),
        }
    )


def sanitize_messages(
    conversations: DataFrame,
    detectors: list[Detector],
    policy: Policy,
    apply_to: str = "both",
    bypass: bool | Column = False,
    rewrite_map: dict | None = None,
) -> DataFrame:
    """Messages before the call, all roles."""
    if apply_to not in ("input", "both") or bypass is True:
        return _off(conversations, "text")
    out = guard_texts(conversations, "text", detectors, policy, rewrite_map)
    if isinstance(bypass, Column):
        out = out.withColumns(
            {
                "clean_text": F.when(bypass, F.col("text")).otherwise(F.col("clean_text")),
                "modified": F.col("modified") & ~bypass,
                "blocked": F.col("blocked") & ~bypass,
                "reason": F.when(~bypass, F.col("reason")),
            }
        )
    return out


def request_verdicts(messages: DataFrame) -> DataFrame:
    """One blocked message blocks its request; the reason is that of the earliest one.

    Only flags and short reasons are shuffled, with map-side combination per request.
    """
    return messages.groupBy("conv_id").agg(
        F.max("blocked").alias("blocked"),
        F.min_by("reason", F.when(F.col("blocked"), F.col("turn"))).alias("reason"),
        F.sum(F.col("modified").cast("long")).alias("modified_messages"),
    )


def sanitize_responses(
    messages: DataFrame,
    detectors: list[Detector],
    policy: Policy,
    apply_to: str = "both",
    rewrite_map: dict | None = None,
) -> DataFrame:
    """Assistant turns after the call; a blocked one is replaced as a whole."""
    answers = messages.filter(F.col("role") == "assistant")
    if apply_to not in ("output", "both"):
        return _off(answers, "text")
    out = guard_texts(answers, "text", detectors, policy, rewrite_map)
    suppressed = F.when(F.col("blocked"), F.lit(pii.SUPPRESSED_RESPONSE))
    return out.withColumn("clean_text", suppressed.otherwise(F.col("clean_text")))


def guarded_query(messages: DataFrame) -> DataFrame:
    """Last user message of each request before and after guarding, with its diff state."""
    is_user = F.col("role") == "user"
    last = F.struct(F.col("text").alias("original"), F.col("clean_text").alias("guarded"))
    per_request = messages.groupBy("conv_id").agg(
        F.max_by(F.when(is_user, last), F.when(is_user, F.col("turn"))).alias("last"),
        F.max("blocked").alias("blocked"),
    )
    original = F.col("last.original")
    guarded = F.when(~F.col("blocked"), F.col("last.guarded"))
    state = (
        F.when(F.col("blocked"), "blocked")
        .when(F.col("last").isNull(), "no_query")
        .when(guarded.eqNullSafe(original), "unchanged")
        .otherwise("modified")
    )
    return per_request.select(
        "conv_id", original.alias("original"), guarded.alias("guarded"), state.alias("state")
    )
