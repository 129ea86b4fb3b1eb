"""Ordered safety screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import safety
from ..functions.regex import folded_sql, found_sql
from ..functions.spans import name
from ..schemas import SAFETY_RULES
from ..session import small_table

RULES = safety.rules()


def load_safety(spark: SparkSession, enabled: dict | None = None, action: dict | None = None) -> DataFrame:
    """Rules with their guard's switch and action: a table that ``screen`` takes, to add rules to or to take some from."""
    enabled = safety.DEFAULT_ENABLED if enabled is None else enabled
    action = safety.DEFAULT_ACTIONS if action is None else action
    rules = small_table(spark, RULES, SAFETY_RULES)
    config = [(g, bool(enabled.get(g, False)), action.get(g, "BLOCK")) for g in safety.GUARD_ORDER]
    switches = small_table(spark, config, "guard string, enabled boolean, action string")
    return rules.join(switches, "guard")


def ordered_rules(rules: DataFrame | None, enabled: dict | None = None, action: dict | None = None) -> list[tuple]:
    """(guard, tier, ord, pattern, reason, enabled, block) in evaluation order: that of guards, then of numbers.

    ``rules``: a table as ``load_safety`` makes it, or None for the catalogue. Rules are configuration and part of the
    plan; guards beyond the known ones come last, by name.
    """
    if rules is None:
        enabled = safety.DEFAULT_ENABLED if enabled is None else enabled
        action = safety.DEFAULT_ACTIONS if action is None else action
        return [(*r, bool(enabled.get(r[0], False)), action.get(r[0], "BLOCK") == "BLOCK") for r in RULES]
    rank = {guard: i for i, guard in enumerate(safety.GUARD_ORDER)}
    rows = [(r.guard, r.tier, r.ord, r.pattern, r.reason, bool(r.enabled), r.action == "BLOCK") for r in rules.collect()]
    return sorted(rows, key=lambda r: (rank.get(r[0], len(rank)), r[0], r[2]))


def screen(
    df: DataFrame, text: str, enabled: dict | None = None, action: dict | None = None, rules: DataFrame | None = None
) -> DataFrame:
    """Add flagged, guard, tier, rule, reason and should_block.

    The first rule that hits, in guard order, decides: a guard that only logs still ends the
    search. Each regex runs only on texts that contain one of its necessary literals. The rules
    sit in a lambda over the folded text: folded once, and kept out of generated code, whose
    method size sixty-five branches would exceed. ``rules`` replaces catalogue, switches and actions.
    """
    known = ordered_rules(rules, enabled, action)
    active = [(i, r) for i, r in enumerate(known) if r[5]]
    place = F.lit(None).cast("int")
    if active:
        whens = " ".join(f"WHEN {found_sql(name(text), 'low', r[3])} THEN {i}" for i, r in active)
        low = folded_sql(name(text))
        place = F.expr(f"get(transform(array({low}), low -> CASE {whens} END), 0)")
    facts = F.array(
        *[
            F.struct(
                F.lit(guard).alias("guard"), F.lit(tier).alias("tier"), F.lit(ord_).cast("int").alias("rule"),
                F.lit(reason).alias("reason"), F.lit(block).alias("block"),
            )
            for guard, tier, ord_, _, reason, _, block in known or [("", "", 0, "", "", False, False)]
        ]
    )
    out = df.withColumn("_place", place)
    fact = F.when(F.col("_place").isNotNull(), F.element_at(facts, F.col("_place") + 1))
    return out.withColumn("_fact", fact).select(
        "*",
        "_fact.rule",
        F.col("_place").isNotNull().alias("flagged"),
        "_fact.guard",
        "_fact.tier",
        "_fact.reason",
        F.coalesce("_fact.block", F.lit(False)).alias("should_block"),
    ).drop("_fact", "_place")


def screen_guard(df: DataFrame, text: str, guard: str) -> DataFrame:
    return screen(df, text, {guard: True})


def screen_messages(messages: DataFrame, text: str = "text", **config) -> DataFrame:
    """Verdicts of user messages; other roles are not screened."""
    return screen(messages.filter(F.col("role") == "user"), text, **config)


def screen_requests(messages: DataFrame, text: str = "text", **config) -> DataFrame:
    """Per request: the earliest blocking message blocks it.

    Only rule numbers are shuffled: turn and rule travel as one long with map-side minimum.
    """
    verdicts = screen_messages(messages, text, **config)
    known = ordered_rules(config.get("rules"))
    bits = max(10, max((r[2] for r in known), default=0).bit_length())
    packed = F.col("turn") * (1 << bits) + F.col("rule")
    per_request = verdicts.groupBy("conv_id").agg(
        F.min(F.when(F.col("should_block"), packed)).alias("first")
    )
    pairs = [x for r in known for x in (F.lit(r[2]).cast("long"), F.struct(F.lit(r[0]).alias("guard"), F.lit(r[4]).alias("reason")))]
    names = F.create_map(*pairs) if pairs else F.lit(None).cast("map<bigint,struct<guard:string,reason:string>>")
    fact = F.when(F.col("first").isNotNull(), names[F.col("first") % (1 << bits)])
    return per_request.select(
        "conv_id",
        F.col("first").isNotNull().alias("blocked"),
        F.shiftright("first", bits).alias("block_turn"),
        fact["guard"].alias("guard"),
        fact["reason"].alias("reason"),
    )


def safety_events(messages: DataFrame, text: str = "text", **config) -> DataFrame:
    """Hits in the order they are met: nothing after a request's blocking message."""
    verdicts = screen_messages(messages, text, **config)
    hits = verdicts.filter("flagged").select("conv_id", "turn", "rule", "guard", "reason", "should_block")
    ends = hits.filter("should_block").groupBy("conv_id").agg(F.min("turn").alias("end"))
    return (
        hits.join(ends, "conv_id", "left")
        .filter(F.col("end").isNull() | (F.col("turn") <= F.col("end")))
        .select(
            "conv_id", "turn", "guard", "rule", "reason",
            F.when(F.col("should_block"), "BLOCKED").otherwise("LOGGED").alias("outcome"),
        )
    )


def safety_report(verdicts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Hits per guard and rule with subtotals; rules without hits are listed with zero."""
    spark = verdicts.sparkSession
    hits = verdicts.filter("flagged").groupBy("rule").agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum(F.col("should_block").cast("long")).alias("blocked"),
    )
    listed = small_table(spark, RULES, SAFETY_RULES) if rules is None else rules
    full = listed.select("guard", "tier", F.col("ord").alias("rule")).join(hits, "rule", "left")
    return full.rollup("guard", "rule").agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"),
        (F.coalesce(F.sum("hits"), F.lit(0)) - F.coalesce(F.sum("blocked"), F.lit(0))).alias("logged"),
    )
