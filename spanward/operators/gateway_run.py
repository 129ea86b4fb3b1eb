"""Requests from their messages to the log, as one job.

Messages are sanitised, user messages screened as sanitised; a message that the policy blocks ends its request before
any screening, and one that a rule blocks ends it before routing. What is left is measured as sanitised, routed, tried
endpoint by endpoint, priced and counted. Everything a message contributes is found on its own row and written once;
requests are put together from flags and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import gateway as g
from ..catalog import pii
from . import analysis, failover, ledger, routing
from .detect import Detector, Policy
from .redact import sanitize_messages
from .safety import screen

#: Steps of a request in the order in which they log.
GUARD, ROUTE, ANSWER = 0, 1, 2


def guard_messages(
    messages: DataFrame, detectors: list[Detector], policy: Policy, rewrite_map: dict | None = None,
    enabled: dict | None = None, action: dict | None = None,
) -> DataFrame:
    """(conv_id, turn, role, text, modified, pii_blocked, pii_reason, guard, rule, reason, should_block), one row a message.

    ``text`` is the sanitised one; rules look at that of users.
    """
    clean = sanitize_messages(messages, detectors, policy, rewrite_map=rewrite_map).select(
        "conv_id", "turn", "role", F.col("clean_text").alias("text"), "modified", F.col("blocked").alias("pii_blocked"), F.col("reason").alias("pii_reason"),
        F.when(F.col("role") == "user", F.col("clean_text")).alias("_asked"),
    )
    return screen(clean, "_asked", enabled, action).drop("_asked", "flagged", "tier")


def outcomes(guarded: DataFrame) -> DataFrame:
    """(conv_id, pii_end, safety_end, blocked_by, block_reason): where a request ends before routing, if it does."""
    by_turn = F.when(F.col("should_block"), F.col("turn"))
    ends = guarded.groupBy("conv_id").agg(
        F.min(F.when(F.col("pii_blocked"), F.col("turn"))).alias("pii_end"),
        F.min_by("pii_reason", F.when(F.col("pii_blocked"), F.col("turn"))).alias("labels"),
        F.min(by_turn).alias("rule_end"),
        F.min_by(F.struct("guard", "reason"), by_turn).alias("rule"),
    )
    by_policy = F.col("pii_end").isNotNull()
    ruled = F.concat(F.lit("Request blocked by "), F.col("rule.guard"), F.lit(" guardrail: "), F.col("rule.reason"))
    return ends.select(
        "conv_id", "pii_end", F.when(~by_policy, F.col("rule_end")).alias("safety_end"),
        F.when(by_policy, "pii").otherwise(F.col("rule.guard")).alias("blocked_by"),
        F.when(by_policy, F.concat(F.lit(pii.BLOCK_REASON_PREFIX), "labels")).otherwise(ruled).alias("block_reason"),
    )


def run(guarded: DataFrame, ends: DataFrame, described: DataFrame, endpoints: DataFrame, fallbacks: DataFrame, attempts) -> DataFrame:
    """Requests with their route, answer, status and cost; blocked ones have a status and a reason only.

    ``described``: conv_id with tenant, ts, cluster, max_tokens and output_tokens. ``attempts(routed)`` says how calls
    would end: (request_id, cluster, model, ok).
    """
    measured = analysis.analyze_requests(guarded.select("conv_id", "turn", "role", "text"), described.select("conv_id", "max_tokens"))
    rows = described.join(ends, "conv_id").join(measured.drop("max_tokens"), "conv_id").withColumnRenamed("conv_id", "request_id")
    rows = rows.withColumns({"input_tokens": F.col("prompt_tokens"), "total_tokens": F.col("prompt_tokens") + F.col("output_tokens")})
    routed = routing.route(rows.where("blocked_by IS NULL"), endpoints, fallbacks)
    answers = failover.resolve_failover(routed, attempts(routed)).select("request_id", "answered_by", "status", "failed_over")
    done = routed.join(answers, "request_id")
    answered = done.select("request_id", F.col("answered_by").alias("model"), "input_tokens", "output_tokens").where("model IS NOT NULL")
    costs = ledger.with_cost(answered, endpoints).select("request_id", "cost")
    open_ = done.join(costs, "request_id", "left")
    held = rows.where("blocked_by IS NOT NULL").withColumn("status", F.lit("blocked"))
    return open_.unionByName(held, allowMissingColumns=True)


def log(guarded: DataFrame, ends: DataFrame, runs: DataFrame) -> DataFrame:
    """(request_id, step, pos, type, code, model, detail): everything that happened, in the order of step and pos."""
    known = guarded.join(ends, "conv_id")
    before = F.col("pii_end").isNull() | (F.col("turn") <= F.col("pii_end"))
    screened = F.col("pii_end").isNull() & (F.col("safety_end").isNull() | (F.col("turn") <= F.col("safety_end")))
    none = F.lit(None).cast("string")

    def event(step, pos, kind, code, model, detail) -> Column:
        return F.struct(
            F.lit(step).alias("step"), pos.cast("long").alias("pos"), F.lit(kind).alias("type"), code.alias("code"), model.alias("model"), detail.alias("detail")
        )

    def listed(rows: DataFrame, key: str, *events: tuple[Column, Column]) -> DataFrame:
        made = rows.select(F.col(key).alias("request_id"), F.explode(F.array(*[F.when(c, e) for c, e in events])).alias("e"))
        return made.where("e IS NOT NULL").select("request_id", "e.*")

    guards = listed(
        known, "conv_id",
        (before & F.col("modified") & ~F.col("pii_blocked"), event(GUARD, F.col("turn"), "warning", F.lit("sanitized"), none, F.col("role"))),
        (F.col("turn") == F.col("pii_end"), event(GUARD, F.col("turn"), "warning", F.lit("pii_blocked"), none, F.col("block_reason"))),
        (
            screened & F.col("rule").isNotNull(),
            event(GUARD, g.SAFETY_POSITION + F.col("turn"), "warning", F.when(F.col("should_block"), "safety_blocked").otherwise("safety_logged"), none, F.col("guard")),
        ),
    )
    routes = ledger.routing_events(runs.where("blocked_by IS NULL")).select("request_id", F.lit(ROUTE).alias("step"), F.col("seq").cast("long").alias("pos"), "type", "code", "model", "detail")
    answers = listed(
        runs, "request_id",
        (F.col("failed_over"), event(ANSWER, F.lit(0), "warning", F.lit("failover"), F.col("answered_by"), F.col("model"))),
        (F.col("status") == "success", event(ANSWER, F.lit(1), "success", F.lit("answered"), F.col("answered_by"), F.format_number("cost", 9))),
        (F.col("status") == "failed", event(ANSWER, F.lit(1), "error", F.lit("failed"), F.col("model"), none)),
    )
    return guards.unionByName(routes).unionByName(answers)
