"""Guarding messages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.detect import Detector, Policy
from ..operators.redact import guard_texts
from ..operators.safety import screen


def stream_guard(
    messages: DataFrame,
    detectors: list[Detector],
    policy: Policy,
    rewrite_map: dict | None = None,
    enabled: dict | None = None,
    action: dict | None = None,
) -> DataFrame:
    """Redact, then screen what is left; stateless, so batch and stream are the same expressions.

    Only user messages are screened; the verdict of other roles is empty.
    """
    clean = guard_texts(messages, "text", detectors, policy, rewrite_map).withColumnRenamed("reason", "pii_reason")
    clean = clean.selectExpr("*", "CASE WHEN role = 'user' THEN clean_text END AS screened_text")
    return screen(clean, "screened_text", enabled, action).drop("screened_text")
