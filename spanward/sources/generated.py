"""Sentences from raw generator output and samples from tagged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.factory import BATCH_SIZE
from ..functions.regex import jvm_pattern, strip
from ..functions.spans import entity, flatten, no_entities

# The formats looked for.
JSON_ARRAY = r"(\[.*\])"
JSON_OBJECT = r"(\{.*\})"
FENCE_START = r"^```(?:json)?\n?"
FENCE_END = r"\n?```$"
NUMBERING = r"^\d+[\s.)-]+\s*"
JSON_SCALAR = r'\A(?:-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|"(?:[^"\\\x00-\x1f]|\\.)*")\z'
TAGGED = r"<([a-zA-Z0-9_\- ]+?)>(.*?)</\1>"


def _payload(raw: Column) -> Column:
    array = F.regexp_extract(raw, jvm_pattern(JSON_ARRAY, dotall=True), 1)
    obj = F.regexp_extract(raw, jvm_pattern(JSON_OBJECT, dotall=True), 1)
    unfenced = F.regexp_replace(F.regexp_replace(raw, jvm_pattern(FENCE_START), ""), jvm_pattern(FENCE_END), "")
    return (
        F.when(array != "", strip(array))
        .when(obj != "", F.concat(F.lit("["), strip(obj), F.lit("]")))
        .when(raw.startswith("```"), strip(unfenced))
        .otherwise(strip(raw))
    )


def _parsed(payload: Column) -> Column:
    """Array of strings if the payload is one valid JSON array, else null.

    The parser stops at the first closing bracket, so a payload whose text goes on behind it
    is recognised by the length of what was read: it must be one top-level value.
    """
    options = {"allowSingleQuotes": "false"}
    whole = F.from_json(
        F.concat(F.lit('{"v":'), payload, F.lit(',"end":"1"}')), "v array<string>, end string", options
    )
    items = F.transform(whole["v"], lambda x: F.coalesce(x, F.lit("None")))
    # a lone JSON value is valid, but holds no sentences
    lone = F.when(payload.rlike(JSON_SCALAR), F.array().cast("array<string>"))
    return F.coalesce(lone, F.when(whole["end"] == "1", items))


def _lines(payload: Column, batch_size: Column) -> Column:
    rows = F.transform(F.split(payload, "\n", -1), strip)
    kept = F.filter(
        rows,
        lambda r: (r != "") & ~r.startswith("```") & ~r.startswith("[") & ~r.endswith("]"),
    )
    bare = F.transform(kept, lambda r: F.regexp_replace(r, jvm_pattern(NUMBERING), ""))

    def unquote(r):
        quoted = (r.startswith('"') & r.endswith('"')) | (r.startswith("'") & r.endswith("'"))
        inner = F.substring(r, F.lit(2), F.greatest(F.char_length(r) - 2, F.lit(0)))
        return F.when(quoted, strip(inner)).otherwise(r)

    return F.slice(F.transform(bare, unquote), F.lit(1), batch_size)


def harvested(raw: Column, batch_size: Column | int = BATCH_SIZE) -> Column:
    """Sentences of one raw output. Nested JSON values are given as their JSON text."""
    size = batch_size if isinstance(batch_size, Column) else F.lit(batch_size)
    payload = _payload(raw)
    return F.coalesce(_parsed(payload), _lines(payload, size))


def harvest_generations(raw: DataFrame, batch_size: Column | int = BATCH_SIZE) -> DataFrame:
    """(batch_id, pos, sentence) from (batch_id, raw)."""
    return flatten(raw, harvested(F.col("raw"), batch_size), "sentence", "batch_id", pos="pos")


def ingest_tagged(df: DataFrame, text_col: str) -> DataFrame:
    """Add text and entities from ``<label>value</label>`` markup.

    Gaps, labels and values are three regex passes; offsets in the clean text are sums of their
    lengths.
    """
    pattern = jvm_pattern(TAGGED)
    source = F.col(text_col)
    pieces = F.arrays_zip(
        F.split(source, pattern, -1).alias("gap"),
        F.regexp_extract_all(source, F.lit(pattern), F.lit(1)).alias("label"),
        F.regexp_extract_all(source, F.lit(pattern), F.lit(2)).alias("value"),
    )
    state = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit(0).alias("pos"), no_entities().alias("spans")
    )

    def step(acc, p):
        begin = acc["pos"] + F.char_length(p["gap"])
        value = F.coalesce(p["value"], F.lit(""))
        span = entity(
            F.lower(strip(p["label"])), begin, begin + F.char_length(value), F.lit(None).cast("double"), value
        )
        return F.struct(
            F.concat(acc["parts"], F.array(p["gap"], value)).alias("parts"),
            (begin + F.char_length(value)).alias("pos"),
            F.when(p["label"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"),
        )

    folded = F.aggregate(pieces, state, step)
    return df.withColumn("_f", folded).select(
        "*", F.array_join("_f.parts", "").alias("text"), F.col("_f.spans").alias("entities")
    ).drop("_f")
