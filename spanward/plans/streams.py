"""Streaming forms, run over the files that are there and compared with batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import pii
from ..operators.detect import Policy, catalogue_detectors
from ..session import fresh_path
from ..streaming import budget, feeds, guard, usage
from . import gateway, privacy, sqltext as q


#: Batches that a table is read in, in no order of time; each is as many files as there are cores.
PARTS = 5


def _stream(spark, sf, table: str, spread_by: str):
    """A table as a stream of several batches whose rows are in no order."""
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    path, files = fresh_path(spark, f"{table}-files"), spark.sparkContext.defaultParallelism
    rows.repartition(PARTS * files, F.expr(f"xxhash64({spread_by})")).write.parquet(path)
    return feeds.read_stream(spark, path, rows.schema, files_per_batch=files)


def stream_usage(spark, sf):
    model = F.element_at(F.create_map(*[F.lit(x) for kv in gateway.MODEL_OF.items() for x in kv]), F.col("event_type"))
    feed = _stream(spark, sf, "events", "event_id").select("ts", model.alias("model"), F.floor(F.col("value") * 1000).alias("tokens"))
    out = usage.stream_usage(feed)
    return out.select(F.unix_micros("window_start").alias("window_start"), "model", "tpm", "rpm")


def stream_counters(spark, sf):
    out = usage.stream_counters(_stream(spark, sf, "events", "event_id"), "event_type")
    return out.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n")


def stream_latest(spark, sf):
    return usage.stream_latest(_stream(spark, sf, "events", "event_id"), "event_id").select("event_id", "event_type")


def stream_guard(spark, sf):
    out = guard.stream_guard(
        _stream(spark, sf, "conversations", "conv_id, turn"), catalogue_detectors(privacy.MESSAGE_LABELS),
        Policy(privacy.MESSAGE_POLICY), pii.REWRITE_PHRASES,
    )
    return feeds.to_table(out.select("conv_id", "turn", "clean_text", "modified", "blocked", "pii_reason", "flagged")).drop("batch")


def stream_budget(spark, sf):
    requests = gateway.requests(spark, sf).select("tenant", "epoch", "ts", "request_id", "required_context", "total_tokens")
    path = fresh_path(spark, "requests-files")
    requests.repartition(PARTS, F.expr("xxhash64(request_id)")).write.parquet(path)
    stream = feeds.read_stream(spark, path, requests.schema, files_per_batch=1)
    return budget.settled_budget(stream, gateway._preferences(gateway.PREFERRED, gateway.LIMITS))


QUERIES = {fn.__name__: fn for fn in (stream_usage, stream_counters, stream_latest, stream_guard, stream_budget)}

ORACLES = {
    "stream_usage": f"""WITH {gateway._FEED}, w AS (SELECT *, (epoch_us(ts) // 5000000 - unnest(range(0, 12))) * 5000000 AS window_start FROM feed)
        SELECT window_start, model, CAST(sum(tokens) AS BIGINT) AS tpm, count(*) AS rpm FROM w GROUP BY ALL""",
    "stream_counters": "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_latest": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "stream_guard": f"""WITH {privacy._MSG_CTE} SELECT conv_id, turn, clean_text, modified, blocked, reason AS pii_reason,
        role = 'user' AND ({q.rule_case('clean_text')}) IS NOT NULL AS flagged FROM msgs""",
}
