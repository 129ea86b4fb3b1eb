"""Token accounting and complexity of requests."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import gateway as g
from ..functions.regex import sql_literal
from ..functions.spans import name
from ..session import ship


def tokens(text: Column) -> Column:
    """About four characters per token, at least one for a non-empty text."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    by_length = F.greatest(F.lit(1), F.floor(n / g.CHARS_PER_TOKEN).cast("int"))
    return F.when(n == 0, F.lit(0)).otherwise(by_length).cast("long")


_TOKENIZERS: dict[str, Callable[[], Callable[[str], int]]] = {}


def register_tokenizer(name_: str, load: Callable[[], Callable[[str], int]]) -> None:
    """Register a tokenizer of one's own: ``load`` runs once per task and returns text -> count."""
    _TOKENIZERS[name_] = load


def plugin_tokens(text: Column, name_: str) -> Column:
    load = _TOKENIZERS[name_]

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = load()
        for batch in batches:
            yield batch.map(lambda t: one(t) if t else 0).astype("int64")

    return count(text)


def request_tokens(messages: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Prompt tokens per request, by the length estimate or a registered tokenizer."""
    if tokenizer is None:
        content, role = tokens(F.col(text)), tokens(F.col("role"))
    else:
        ship(messages.sparkSession)
        content, role = plugin_tokens(F.col(text), tokenizer), plugin_tokens(F.col("role"), tokenizer)
    total = (F.sum(content + role + g.MESSAGE_OVERHEAD) + g.REQUEST_OVERHEAD).alias("prompt_tokens")
    return messages.groupBy("conv_id").agg(total)


def _hits(low: str, words: list[str]) -> Column:
    return F.expr(" + ".join(f"cast(contains({name(low)}, {sql_literal(w)}) AS bigint)" for w in words))


def _count_char(low: str, char: str) -> Column:
    return F.char_length(low) - F.char_length(F.replace(F.col(low), F.lit(char), F.lit("")))


def high_hits(low: str) -> Column:
    """Keywords contained (each once), plus three for anything that looks like code."""
    code = functools.reduce(lambda a, b: a | b, [F.contains(F.col(low), F.lit(m)) for m in g.CODE_MARKERS])
    braces = (_count_char(low, "{") > g.BRACES_OVER) & (_count_char(low, "}") > g.BRACES_OVER)
    bonus = F.when(code | braces, F.lit(g.CODE_MARKER_WEIGHT)).otherwise(F.lit(0))
    return _hits(low, g.HIGH_KEYWORDS) + bonus


def tier(context: Column, high: Column, medium: Column, is_long: Column) -> Column:
    return (
        F.when(context > g.HIGH_CONTEXT, "high")
        .when((high >= 2) | ((high >= 1) & (context > g.KEYWORD_CONTEXT)), "high")
        .when((medium >= 1) | (context > g.MEDIUM_CONTEXT) | is_long, "medium")
        .otherwise("low")
    )


def analyze_requests(messages: DataFrame, max_tokens: Column | DataFrame | None = None, text: str = "text") -> DataFrame:
    """Per request: prompt_tokens, required_context, high_count, medium_count, complexity.

    ``max_tokens``: an expression over conv_id, or a table (conv_id, max_tokens, ...) whose columns
    are kept; the default limit applies where it is missing.

    Keyword features are taken per message; the last user message is then the largest of a
    packed long (turn, high, medium, long), so that the one shuffle carries numbers, never texts.
    """
    low = F.lower(F.col(text))
    features = messages.select(
        "conv_id", "turn", "role", text, low.alias("_low")
    ).select(
        "conv_id",
        (tokens(F.col(text)) + tokens(F.col("role")) + g.MESSAGE_OVERHEAD).alias("n"),
        F.when(
            F.col("role") == "user",
            F.col("turn") * 8192
            + F.coalesce(high_hits("_low"), F.lit(0)) * 64
            + F.coalesce(_hits("_low", g.MEDIUM_KEYWORDS), F.lit(0)) * 2
            + F.coalesce((F.char_length(text) > g.LONG_MESSAGE).cast("long"), F.lit(0)),
        ).alias("packed"),
    )
    per_request = features.groupBy("conv_id").agg(
        (F.sum("n") + g.REQUEST_OVERHEAD).alias("prompt_tokens"),
        F.coalesce(F.max("packed"), F.lit(0)).alias("packed"),
    )
    limit = F.lit(None).cast("long")
    if isinstance(max_tokens, DataFrame):
        per_request = max_tokens.join(per_request, "conv_id")
        limit = F.col("max_tokens")
    elif max_tokens is not None:
        limit = max_tokens
    limit = F.coalesce(limit, F.lit(g.DEFAULT_MAX_TOKENS))
    out = per_request.withColumns(
        {
            "required_context": F.col("prompt_tokens") + limit.cast("long"),
            "high_count": F.shiftright("packed", 6) % 128,
            "medium_count": F.shiftright("packed", 1) % 32,
        }
    )
    return out.withColumn(
        "complexity",
        tier(F.col("required_context"), F.col("high_count"), F.col("medium_count"), F.col("packed") % 2 == 1),
    ).drop("packed")
