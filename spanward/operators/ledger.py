"""Cost, counters, decision log, endpoint catalogue and session history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import gateway as g
from ..functions.scale import numbered, running_totals
from ..functions.spans import flatten


def prices(endpoints: DataFrame) -> DataFrame:
    """Price of a physical model: that of its first row. Bounded by the endpoint catalogue."""
    return endpoints.groupBy("model").agg(F.min_by("cost_per_million", "ord").alias("price"))


def with_cost(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Add cost to rows with model, input_tokens and output_tokens."""
    priced = calls.join(prices(endpoints), "model", "left")
    price = F.coalesce("price", F.lit(g.DEFAULT_COST))
    total = F.col("input_tokens") + F.col("output_tokens")
    return priced.withColumn("cost", total * price / F.lit(1_000_000.0)).drop("price")


def cost_ledger(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Cost of each call and the running spend of its model, in (ts, request_id) order.

    Few models hold all calls, hence the sliced running total.
    """
    costed = with_cost(calls, endpoints)
    return running_totals(costed, ["model"], ["ts", "request_id"], {"running_spend": F.col("cost")})


def gateway_metrics(calls: DataFrame) -> DataFrame:
    """Totals; a blocked request is neither a success nor a failure."""
    ok, failed = F.col("status") == "success", F.col("status") == "failed"
    rerouted = (F.col("is_fallback") & (ok | failed)).cast("long")
    if "failed_over" in calls.columns:
        rerouted = rerouted + (F.col("failed_over") & ok).cast("long")

    def count(c):
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    return calls.agg(
        F.count(F.lit(1)).alias("total_requests"),
        count(ok).alias("successful_requests"),
        count(failed).alias("failed_requests"),
        F.coalesce(F.sum(F.when(ok, F.col("input_tokens"))), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0)).alias("total_output_tokens"),
        F.coalesce(F.sum(rerouted), F.lit(0)).alias("fallback_events"),
    )


def provider_calls(calls: DataFrame) -> DataFrame:
    """Successful calls per model and complexity, with subtotals."""
    ok = calls.filter(F.col("status") == "success")
    return ok.rollup("model", "complexity").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens")
    )


AFTER_REJECTIONS = 1_000_000


def routing_events(routed: DataFrame) -> DataFrame:
    """One row per analysis, rejection, fallback, selection and escalation.

    ``seq`` orders the events of one request; clusters behind the winning one were never visited.
    All events of a request are laid out from its own row, so requests are routed once.
    """

    def event(seq, kind, code, model, detail):
        return F.struct(
            seq.cast("int").alias("seq"), kind.alias("type"), F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"),
            model.cast("string").alias("model"), detail.alias("detail"),
        )

    def if_(condition, item):
        return F.array(F.when(condition, item))

    warning, model, over = F.lit("warning"), F.col("model"), F.col("over_limit")
    analysis = event(F.lit(0), F.lit("routing"), "analysis", F.lit(None), F.col("complexity"))
    rejections = F.transform(
        "candidates",
        lambda c, i: F.when(
            (c["cluster_rank"] <= F.col("visited_rank")) & c["reject_reason"].isNotNull(),
            event(i + 1, warning, "rejected", c["model"], c["reject_reason"]),
        ),
    )
    fallback = event(F.lit(AFTER_REJECTIONS), warning, "fallback", model, F.col("selected_cluster"))
    chosen = event(
        F.lit(AFTER_REJECTIONS + 1), F.when(over, warning).otherwise("success"),
        F.when(over, "over_limit").otherwise("selected"), model, F.col("selected_cluster"),
    )
    events = F.concat(
        F.array(analysis), F.coalesce(rejections, F.expr("array()").cast(_EVENTS_DDL)),
        if_(F.col("is_fallback") & ~over, fallback), if_(model.isNotNull(), chosen),
    )
    return flatten(routed, events, "e", "request_id", "ts").select("request_id", "ts", "e.*")


_EVENTS_DDL = "array<struct<seq:int,type:string,code:string,model:string,detail:string>>"


def latest_events(events: DataFrame, n: int = g.LATEST_EVENTS) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("request_id"), F.desc("seq")).limit(n)


def model_catalog(endpoints: DataFrame) -> DataFrame:
    """Clusters and physical models with owner, limits and first-seen quota and price."""
    first = F.min_by(
        F.struct(F.coalesce("tpm", F.lit(g.CATALOGUE_TPM)).alias("tpm"),
                 (F.coalesce("cost_per_million", F.lit(g.CATALOGUE_COST)) / 1000.0).alias("cost")),
        "ord",
    )
    virtual = endpoints.groupBy(F.col("cluster").alias("id")).agg(first.alias("first")).select(
        "id", F.lit("proxy-system").alias("owned_by"), F.lit("virtual").alias("type"),
        F.col("first.tpm").alias("default_tpm"), F.col("first.cost").alias("price_per_k"),
    )
    firsts = endpoints.groupBy("model").agg(first.alias("first"))
    physical = endpoints.join(firsts, "model").select(
        F.col("model").alias("id"), F.split_part("model", F.lit("/"), F.lit(1)).alias("owned_by"),
        F.lit("physical").alias("type"), F.col("first.tpm").alias("default_tpm"),
        F.col("first.cost").alias("price_per_k"), "ord",
        F.col("tpm").alias("tpm_limit"), F.col("rpm").alias("rpm_limit"), F.col("tpr").alias("tpr_limit"),
    )
    return virtual.unionByName(physical, allowMissingColumns=True)


def providers(endpoints: DataFrame) -> DataFrame:
    return endpoints.select(F.split_part("model", F.lit("/"), F.lit(1)).alias("provider")).distinct()


def session_history(queries: DataFrame) -> DataFrame:
    """Turns of each session numbered by time; order by (session, turn desc) to read newest first."""
    return numbered(queries, ["session"], ["ts", "request_id"], "turn_number")


def latency_summary(queries: DataFrame) -> DataFrame:
    return queries.groupBy("model").agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("latency").alias("mean_latency"),
        F.percentile_approx("latency", 0.5).alias("median_latency"),
    )
