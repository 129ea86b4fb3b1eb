"""Near-duplicate sentences within one generated batch."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.factory import NEAR_DUPLICATE_RATIO, PLACEHOLDER
from ..session import ship


def keep_first(sentences, threshold: float) -> list[str]:
    """Sentences whose ratio to every earlier kept one is at most ``threshold``.

    The two cheap upper bounds of the ratio decide most pairs without the full comparison.
    """
    kept, matchers = [], []
    for raw in sentences:
        sentence = raw.strip()
        if not sentence:
            continue
        clean = sentence.replace(PLACEHOLDER, "").strip().lower()
        for m in matchers:
            m.set_seq1(clean)
            if m.real_quick_ratio() > threshold and m.quick_ratio() > threshold and m.ratio() > threshold:
                break
        else:
            kept.append(sentence)
            matcher = SequenceMatcher(None)
            matcher.set_seq2(clean)
            matchers.append(matcher)
    return kept


def distinct_sentences(sentences: Column, threshold: float = NEAR_DUPLICATE_RATIO) -> Column:
    """A batch is one generator output and stays one row, so nothing is shuffled or collected."""

    @F.pandas_udf("array<string>")
    def accept(batches: pd.Series) -> pd.Series:
        return batches.map(lambda b: [] if b is None else keep_first(b, threshold))

    return accept(sentences)


def drop_near_duplicates(
    batches: DataFrame, sentences: str = "sentences", threshold: float = NEAR_DUPLICATE_RATIO
) -> DataFrame:
    """Add accepted and near_dups (blank sentences count among them)."""
    ship(batches.sparkSession)
    out = batches.withColumn("accepted", distinct_sentences(F.col(sentences), threshold))
    return out.withColumn("near_dups", F.size(sentences) - F.size("accepted"))
