"""Queries over conversations read as requests, and over events read as usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import gateway as g
from ..catalog import pii
from ..operators import detect as d
from ..operators import gateway_run as handled
from ..operators import analysis, budget, failover, ledger, routing, shared_rates, usage
from ..sources.config import load_endpoints, load_fallbacks, search_chains
from ..session import materialise, read_table, read_texts
from . import sqltext as q
from .privacy import MESSAGE_POLICY, PROBED_SQL, probed
from .sqltext import quote

# How conversations and events are read as gateway traffic.
EPOCH = 1_704_067_200_000_000
STEP = 83_000_000
MAX_TOKENS = [100, 1000, 8000, 140000]
MODEL_OF = {
    "view": "groq/llama-3.1-8b-instant",
    "click": "cerebras/llama3.1-8b",
    "purchase": "groq/llama-3.3-70b-versatile",
    "error": "together_ai/meta-llama/Meta-Llama-3.1-8B-Instruct-Turbo",
    "signup": "together_ai/meta-llama/Llama-3.3-70B-Instruct-Turbo",
}
REPLY_TOKENS = 60
PREFERRED = ["groq/llama-3.1-8b-instant", "cerebras/llama3.1-8b", "groq/llama-3.3-70b-versatile"]
LIMITS = {PREFERRED[0]: 0.0001, PREFERRED[1]: 0.00003, PREFERRED[2]: 0.002}
SHARED_STEP = 7_000_000
SHARED_LIMITS = {PREFERRED[0]: 0.0003, PREFERRED[1]: 0.00003, PREFERRED[2]: 0.02}
SCARCE = {PREFERRED[0]: {"rpm": 3}, PREFERRED[1]: {"rpm": 2, "tpm": 9000}, PREFERRED[2]: {"rpm": 2}}
NARROW_FIRST = [PREFERRED[1], PREFERRED[0], PREFERRED[2]]
NARROW_LIMITS = {PREFERRED[1]: 0.00002, PREFERRED[0]: 0.0004, PREFERRED[2]: 0.5}


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return read_texts(spark, sf, "conversations", "conv_id", "turn")


def max_tokens():
    return F.element_at(F.array(*[F.lit(m) for m in MAX_TOKENS]), (F.col("conv_id") % 4 + 1).cast("int")).cast("long")


def analyzed(spark, sf) -> DataFrame:
    return analysis.analyze_requests(messages(spark, sf), max_tokens())


def requests(spark, sf) -> DataFrame:
    """One request per conversation, in the order of its number."""
    rows = analyzed(spark, sf)
    conv = F.col("conv_id")
    return rows.select(
        conv.alias("request_id"),
        F.concat(F.lit("t"), (conv % 10).cast("string")).alias("tenant"),
        F.floor(conv / F.lit(60)).alias("epoch"),
        F.timestamp_micros(F.lit(EPOCH) + conv * STEP).alias("ts"),
        F.when(conv % 5 == 0, g.BACKUP_CLUSTER).otherwise("primary-cluster").alias("cluster"),
        "prompt_tokens", "required_context", "complexity",
        F.col("prompt_tokens").alias("input_tokens"),
        F.lit(REPLY_TOKENS).cast("long").alias("output_tokens"),
        (F.col("prompt_tokens") + REPLY_TOKENS).alias("total_tokens"),
    )


def usage_feed(spark, sf) -> DataFrame:
    model = F.element_at(F.create_map(*[F.lit(x) for kv in MODEL_OF.items() for x in kv]), F.col("event_type"))
    return read_table(spark, sf, "events").select(
        "event_id", "ts", model.alias("model"), F.floor(F.col("value") * 1000).alias("tokens")
    )


def _catalogue(spark):
    return load_endpoints(spark), load_fallbacks(spark)


def routed(spark, sf) -> DataFrame:
    return routing.route(requests(spark, sf), *_catalogue(spark))


def with_usage(spark, sf) -> DataFrame:
    endpoints, fallbacks = _catalogue(spark)
    feed = usage_feed(spark, sf).select("ts", "model", "tokens")
    return usage.request_usage(requests(spark, sf), search_chains(endpoints, fallbacks), feed)


def request_tokens(spark, sf):
    return analysis.request_tokens(messages(spark, sf))


def request_complexity(spark, sf):
    return analyzed(spark, sf)


def usage_trailing_60s(spark, sf):
    return usage.trailing_usage(usage_feed(spark, sf)).select("event_id", "model", "tpm", "rpm")


def route_candidates(spark, sf):
    return routing.candidates(requests(spark, sf), *_catalogue(spark)).select(
        "request_id", "cluster_rank", "ord", "model", "reject_reason"
    )


_ROUTE_COLUMNS = ["request_id", "ord", "model", "selected_cluster", "is_fallback", "over_limit"]


def route_selected(spark, sf):
    return routed(spark, sf).select(*_ROUTE_COLUMNS)


def route_escalated(spark, sf):
    return routing.escalated(routed(spark, sf)).select("request_id", "model", "required_context")


def route_with_usage(spark, sf):
    return routing.route(with_usage(spark, sf), *_catalogue(spark)).select(*_ROUTE_COLUMNS)


def candidates_with_usage(spark, sf):
    return routing.candidates(with_usage(spark, sf), *_catalogue(spark)).select(
        "request_id", "ord", "tpm_used", "rpm_used", "reject_reason"
    )


def calls(spark, sf) -> DataFrame:
    status = (
        F.when(F.col("request_id") % 11 == 3, "blocked").when(F.col("request_id") % 13 == 5, "failed").otherwise("success")
    )
    return routed(spark, sf).withColumn("status", status)


def cost_ledger(spark, sf):
    done = calls(spark, sf).filter("status = 'success'").select("request_id", "ts", "model", "input_tokens", "output_tokens")
    return ledger.cost_ledger(done, load_endpoints(spark)).select(
        "request_id", "model", F.round("cost", 9).alias("cost"), F.round("running_spend", 9).alias("running_spend")
    )


def gateway_metrics(spark, sf):
    return ledger.gateway_metrics(calls(spark, sf))


def provider_calls(spark, sf):
    return ledger.provider_calls(calls(spark, sf))


def _preferences(order, limits):
    return budget.preference_rows(order, g.ENDPOINTS, limits)


def preference_budget(spark, sf):
    return budget.route_by_preference(requests(spark, sf), _preferences(PREFERRED, LIMITS)).select(
        "request_id", "preference", "model", "exhausted"
    )


def preference_budget_narrow(spark, sf):
    """The first preference has the smallest context."""
    return budget.route_by_preference(requests(spark, sf), _preferences(NARROW_FIRST, NARROW_LIMITS)).select(
        "request_id", "preference", "model", "exhausted"
    )


def preference_replay(spark, sf):
    """The same walk with live rate limits."""
    return budget.replay(requests(spark, sf), _preferences(PREFERRED, LIMITS)).select(
        "request_id", "preference", "model", "exhausted"
    )


def _scarce() -> list[dict]:
    """The preferences with so little of each model a minute that tenants take it from each other."""
    return [dict(p, **SCARCE[p["model"]]) for p in _preferences(PREFERRED, SHARED_LIMITS)]


def preference_shared(spark, sf):
    """Requests of all tenants, seven seconds apart, with rates that they share."""
    close = requests(spark, sf).withColumn("ts", F.timestamp_micros(F.lit(EPOCH) + F.col("request_id") * SHARED_STEP))
    return shared_rates.route_shared(close, _scarce()).drop("rounds")


GUARDED_LABELS = ["email address", "phone number", "credit card number", "social security number", "bank account number"]
DOWN = "cerebras/llama3.1-8b"


def _attempts(routed: DataFrame) -> DataFrame:
    """One provider is down for every third request, all of them for a few."""
    tried = routed.select("request_id", F.explode("candidates").alias("c")).select("request_id", "c.cluster", "c.model")
    down = ((F.col("model") == DOWN) & (F.col("request_id") % 3 == 0)) | (F.col("request_id") % 17 == 4)
    return tried.withColumn("ok", ~down)


def _handled(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Guarded messages, where requests end, and requests, from messages with probes."""
    found = d.catalogue_detectors(GUARDED_LABELS)
    guarded = handled.guard_messages(probed(spark, sf), found, d.Policy(MESSAGE_POLICY), pii.REWRITE_PHRASES, action={"jailbreak": "LOG"})
    guarded = materialise(guarded, "guarded-messages")
    conv = F.col("conv_id")
    described = guarded.select("conv_id").distinct().select(
        "conv_id", F.timestamp_micros(F.lit(EPOCH) + conv * STEP).alias("ts"),
        F.when(conv % 5 == 0, g.BACKUP_CLUSTER).otherwise("primary-cluster").alias("cluster"),
        max_tokens().alias("max_tokens"), F.lit(REPLY_TOKENS).cast("long").alias("output_tokens"),
    )
    ends = materialise(handled.outcomes(guarded), "outcomes")
    return guarded, ends, handled.run(guarded, ends, described, *_catalogue(spark), _attempts)


def gateway_run(spark, sf):
    runs = _handled(spark, sf)[2]
    open_ = F.col("blocked_by").isNull()
    return runs.select(
        "request_id", "status", "blocked_by", "block_reason", "prompt_tokens", F.when(open_, F.col("complexity")).alias("complexity"),
        "model", "answered_by", F.coalesce("failed_over", F.lit(False)).alias("failed_over"), F.round("cost", 9).alias("cost"),
    )


def gateway_log(spark, sf):
    guarded, ends, runs = _handled(spark, sf)
    return handled.log(guarded, ends, materialise(runs, "runs"))


def gateway_run_metrics(spark, sf):
    """Counters of the whole job: blocked requests count, and an answer by another endpoint is a fallback."""
    return ledger.gateway_metrics(_handled(spark, sf)[2])


def routing_log(spark, sf):
    return ledger.routing_events(routed(spark, sf)).select(
        "request_id", F.col("seq").cast("long").alias("seq"), "type", "code", "model", "detail"
    )


def routing_log_latest(spark, sf):
    return ledger.latest_events(ledger.routing_events(routed(spark, sf))).select(
        "request_id", F.col("seq").cast("long").alias("seq"), "code", "model", "detail"
    )


def model_catalog(spark, sf):
    """The catalogue with the calls each name received as requested cluster or as chosen model."""
    rows = routed(spark, sf)
    served = rows.select(F.explode(F.array("cluster", "model")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("calls"))
    listed = ledger.model_catalog(load_endpoints(spark))
    return listed.join(served, "id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def failover_resolution(spark, sf):
    rows = routed(spark, sf)
    attempts = rows.select("request_id", F.explode("candidates").alias("c")).select(
        "request_id", "c.cluster", "c.model", ((F.col("request_id") * 31 + F.col("c.ord") * 17) % 5 < 1).alias("ok")
    )
    return failover.resolve_failover(rows, attempts)


def session_history(spark, sf):
    rows = routed(spark, sf).select(
        F.col("tenant").alias("session"), "ts", "request_id", "model", (F.col("request_id") % 17 / 10.0).alias("latency")
    )
    return ledger.session_history(rows).select("session", "request_id", "turn_number", "model", "latency")


def latency_summary(spark, sf):
    rows = routed(spark, sf).select("model", (F.col("request_id") % 17 / 10.0).alias("latency"))
    return ledger.latency_summary(rows).select("model", "queries", F.round("mean_latency", 6).alias("mean_latency"))


QUERIES = {
    f.__name__: f
    for f in (
        request_tokens, request_complexity, usage_trailing_60s, route_candidates, route_selected, route_escalated,
        route_with_usage, candidates_with_usage, cost_ledger, gateway_metrics, provider_calls, preference_budget,
        preference_budget_narrow, preference_replay, preference_shared, gateway_run, gateway_log, gateway_run_metrics, routing_log, routing_log_latest, model_catalog,
        failover_resolution, session_history, latency_summary,
    )
}

_TOK = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END"
_HIGH = " + ".join(f"CAST(contains(low, {quote(k)}) AS BIGINT)" for k in g.HIGH_KEYWORDS)
_MEDIUM = " + ".join(f"CAST(contains(low, {quote(k)}) AS BIGINT)" for k in g.MEDIUM_KEYWORDS)
_CODE = " OR ".join(f"contains(low, {quote(m)})" for m in g.CODE_MARKERS)
_ANALYZED = f"""per AS (SELECT conv_id, CAST(sum({_TOK.format('text')} + {_TOK.format('role')} + 4) + 2 AS BIGINT) AS prompt_tokens,
    coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS last FROM conversations GROUP BY conv_id),
  feat AS (SELECT *, prompt_tokens + [{', '.join(map(str, MAX_TOKENS))}][conv_id % 4 + 1] AS required_context, lower(last) AS low FROM per),
  cnt AS (SELECT *, {_HIGH} + CASE WHEN {_CODE} OR (length(low) - length(replace(low, '{{', '')) > 2 AND length(low) - length(replace(low, '}}', '')) > 2) THEN 3 ELSE 0 END AS high_count,
    {_MEDIUM} AS medium_count FROM feat),
  analyzed AS (SELECT conv_id, prompt_tokens, required_context, high_count, medium_count,
    CASE WHEN required_context > 8192 OR high_count >= 2 OR (high_count >= 1 AND required_context > 2048) THEN 'high'
         WHEN medium_count >= 1 OR required_context > 1024 OR length(last) > 500 THEN 'medium' ELSE 'low' END AS complexity FROM cnt)"""
_ENDPOINTS = "endpoints(ord, cluster, model, rpm, tpm, tpr, cost, tier) AS (VALUES " + ", ".join(
    f"({i + 1}, {quote(c)}, {quote(m)}, {r}, {t}, {p}, CAST({x} AS DOUBLE), {quote(k)})" for i, (c, m, r, t, p, x, k) in enumerate(g.ENDPOINTS)
) + "), chains(cluster, cluster_rank, searched) AS (VALUES ('primary-cluster', 0, 'primary-cluster'), ('primary-cluster', 1, 'backup-cluster'), ('backup-cluster', 0, 'backup-cluster'))"
_REQUESTS = f"""requests AS (SELECT conv_id AS request_id, 't' || (conv_id % 10) AS tenant, conv_id // 60 AS epoch,
    make_timestamp({EPOCH} + conv_id * {STEP}) AS ts, CASE WHEN conv_id % 5 = 0 THEN 'backup-cluster' ELSE 'primary-cluster' END AS cluster,
    prompt_tokens, required_context, complexity, prompt_tokens AS input_tokens, {REPLY_TOKENS} AS output_tokens, prompt_tokens + {REPLY_TOKENS} AS total_tokens FROM analyzed)"""
_FEED = "feed AS (SELECT event_id, ts, CASE event_type " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in MODEL_OF.items()) + " END AS model, CAST(floor(value * 1000) AS BIGINT) AS tokens FROM events)"
_TIER = "CASE {} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 2 END"


def _routed(live: bool = False) -> str:
    used = (
        "coalesce((SELECT sum(tokens) FROM feed f WHERE f.model = e.model AND f.ts < r.ts AND f.ts > r.ts - INTERVAL 60 SECOND), 0) AS tpm_used, "
        "(SELECT count(*) FROM feed f WHERE f.model = e.model AND f.ts < r.ts AND f.ts > r.ts - INTERVAL 60 SECOND) AS rpm_used"
        if live else "0 AS tpm_used, 0 AS rpm_used"
    )
    return f"""{_ANALYZED}, {_ENDPOINTS}, {_REQUESTS}, {_FEED},
  used AS (SELECT r.*, c.cluster_rank, c.searched, e.* EXCLUDE (cluster), {used} FROM requests r JOIN chains c ON r.cluster = c.cluster JOIN endpoints e ON e.cluster = c.searched),
  cand AS (SELECT *, abs({_TIER.format('complexity')} - {_TIER.format('tier')}) + CASE WHEN (complexity = 'high' AND tier = 'low') OR (complexity = 'low' AND tier = 'high') THEN 5.0 ELSE 0 END AS mismatch,
    greatest(tpm_used / tpm, rpm_used / rpm) AS util,
    CASE WHEN required_context > tpr THEN 'tpr' WHEN tpm_used + required_context > tpm THEN 'tpm' WHEN rpm_used + 1 > rpm THEN 'rpm' END AS reject_reason FROM used),
  fit AS (SELECT * FROM cand WHERE reject_reason IS NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY cluster_rank, mismatch, cost, util, ord) = 1),
  wide AS (SELECT * FROM (SELECT *, max(tpr) OVER (PARTITION BY request_id) AS m FROM cand) WHERE tpr = m AND request_id NOT IN (SELECT request_id FROM fit)
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY searched <> 'backup-cluster', mismatch, cost, cluster_rank, ord) = 1),
  routed AS (SELECT request_id, tenant, epoch, ts, cluster, complexity, required_context, input_tokens, output_tokens, ord, model, searched AS selected_cluster, searched <> cluster AS is_fallback, false AS over_limit, cluster_rank AS visited FROM fit
    UNION ALL SELECT request_id, tenant, epoch, ts, cluster, complexity, required_context, input_tokens, output_tokens, ord, model, searched, searched <> cluster, true, 9 FROM wide)"""


_ROUTED = _routed()
_STATUS = "CASE WHEN request_id % 11 = 3 THEN 'blocked' WHEN request_id % 13 = 5 THEN 'failed' ELSE 'success' END"
_SELECT = "SELECT request_id, ord, model, selected_cluster, is_fallback, over_limit FROM routed"
_EVENTS = f"""log AS (SELECT request_id, ts, 0 AS seq, 'routing' AS type, 'analysis' AS code, NULL AS model, complexity AS detail FROM routed
    UNION ALL SELECT c.request_id, c.ts, c.pos, 'warning', 'rejected', c.model, c.reject_reason
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY cluster_rank, ord) AS pos FROM cand) c JOIN routed r USING (request_id)
      WHERE c.reject_reason IS NOT NULL AND c.cluster_rank <= r.visited
    UNION ALL SELECT request_id, ts, 1000000, 'warning', 'fallback', model, selected_cluster FROM routed WHERE is_fallback AND NOT over_limit
    UNION ALL SELECT request_id, ts, 1000001, CASE WHEN over_limit THEN 'warning' ELSE 'success' END, CASE WHEN over_limit THEN 'over_limit' ELSE 'selected' END, model, selected_cluster FROM routed)"""


def _walk(order: list[str], limits: dict) -> str:
    prefs = budget.preference_rows(order, g.ENDPOINTS, limits)
    n = len(prefs)
    pick = "CASE " + " ".join(
        f"WHEN s{i} < {p['limit']!r} AND required_context <= {p['tpr']} THEN {i}" for i, p in enumerate(prefs)
    ) + " ELSE -1 END"
    spend = ", ".join(
        f"s{i} + CASE WHEN {'p IN (0, -1)' if i == 0 else f'p = {i}'} THEN total_tokens * {p['cost']!r}::DOUBLE / 1e6 ELSE 0 END AS s{i}"
        for i, p in enumerate(prefs)
    )
    zero = ", ".join(f"0::DOUBLE AS s{i}" for i in range(n))
    cols = ", ".join(f"s{i}" for i in range(n))
    names = "[" + ", ".join(quote(p["model"]) for p in prefs) + "]"
    return f"""WITH RECURSIVE {_ANALYZED}, {_REQUESTS},
  line AS (SELECT tenant, epoch, request_id, required_context, total_tokens, row_number() OVER (PARTITION BY tenant, epoch ORDER BY ts, request_id) AS rn FROM requests),
  walk AS (
    SELECT tenant, epoch, 0::BIGINT AS rn, NULL::BIGINT AS request_id, 0 AS p, {zero} FROM line WHERE rn = 1
    UNION ALL
    SELECT tenant, epoch, rn, request_id, p, {spend} FROM (
      SELECT l.tenant, l.epoch, l.rn, l.request_id, l.total_tokens, {pick} AS p, {cols}
      FROM walk w JOIN line l ON l.tenant = w.tenant AND l.epoch = w.epoch AND l.rn = w.rn + 1))
  SELECT request_id, CASE WHEN p = -1 THEN 0 ELSE p END AS preference, {names}[CASE WHEN p = -1 THEN 1 ELSE p + 1 END] AS model, p = -1 AS exhausted
  FROM walk WHERE rn > 0"""


def _run_sql() -> str:
    """What becomes of each request, from sanitised messages: CTEs up to ``runs``."""
    table = ("probed", "conv_id, turn", GUARDED_LABELS)
    cleaned = q.redacted(*table, MESSAGE_POLICY, "MASK", pii.REWRITE_PHRASES, extra=", role")
    return f"""{PROBED_SQL}, {q.redaction_cte(*table, MESSAGE_POLICY, 'MASK')}, cleaned0 AS MATERIALIZED ({cleaned}),
  {q.rule_table({'jailbreak': 'LOG'})},
  cleaned AS MATERIALIZED (SELECT conv_id, turn, role, clean_text AS text, modified, blocked, reason AS labels, CASE WHEN role = 'user' THEN {q.rule_case('clean_text')} END AS rule FROM cleaned0),
  seen AS MATERIALIZED (SELECT c.*, guard, r.reason, coalesce(block, false) AS stops FROM cleaned c LEFT JOIN rules r USING (rule)),
  ends AS MATERIALIZED (SELECT conv_id, pii_end, CASE WHEN pii_end IS NULL THEN rule_end END AS safety_end,
      CASE WHEN pii_end IS NOT NULL THEN 'pii' ELSE guard END AS blocked_by,
      CASE WHEN pii_end IS NOT NULL THEN {quote(pii.BLOCK_REASON_PREFIX)} || labels ELSE 'Request blocked by ' || guard || ' guardrail: ' || reason END AS block_reason
    FROM (SELECT conv_id, min(turn) FILTER (blocked) AS pii_end, arg_min(labels, turn) FILTER (blocked) AS labels, min(turn) FILTER (stops) AS rule_end,
      arg_min(guard, turn) FILTER (stops) AS guard, arg_min(reason, turn) FILTER (stops) AS reason FROM seen GROUP BY conv_id)),
  {_ROUTED.replace("FROM conversations", "FROM cleaned")},
  tries AS (SELECT c.request_id, c.model, c.searched, r.model AS wanted, CASE WHEN c.searched = r.selected_cluster AND c.model = r.model THEN 0
      WHEN c.searched = r.selected_cluster THEN c.ord WHEN c.ord = min(c.ord) OVER (PARTITION BY c.request_id, c.searched) THEN 10000 + c.cluster_rank * 100 + c.ord END AS step,
      NOT ((c.model = {quote(DOWN)} AND c.request_id % 3 = 0) OR c.request_id % 17 = 4) AS ok FROM cand c JOIN routed r USING (request_id)),
  won AS (SELECT request_id, arg_min(model, step) AS answered_by, min(step) > 0 AS failed_over FROM tries WHERE ok AND step IS NOT NULL GROUP BY request_id),
  prices AS (SELECT model, arg_min(cost, ord) AS price FROM endpoints GROUP BY model),
  runs AS MATERIALIZED (SELECT a.conv_id AS request_id, blocked_by, block_reason, a.prompt_tokens, a.complexity, r.model, r.is_fallback, r.ts, w.answered_by, coalesce(w.failed_over, false) AS failed_over,
      CASE WHEN blocked_by IS NOT NULL THEN 'blocked' WHEN w.answered_by IS NULL THEN 'failed' ELSE 'success' END AS status,
      (a.prompt_tokens + {REPLY_TOKENS}) * coalesce(price, {g.DEFAULT_COST}) / 1000000.0::DOUBLE AS cost
    FROM analyzed a JOIN ends e USING (conv_id) LEFT JOIN routed r ON r.request_id = a.conv_id AND blocked_by IS NULL
      LEFT JOIN won w ON w.request_id = a.conv_id AND blocked_by IS NULL LEFT JOIN prices p ON p.model = w.answered_by)"""


_RUNS = _run_sql()


def _shared_walk() -> str:
    """One request after the other, with all that was taken so far in a list."""
    able = []
    for i, p in enumerate(_scarce()):
        spent = f"coalesce(list_sum(list_transform(list_filter(h, lambda x: x.m = {i} AND x.k = key), lambda x: x.tok)), 0)"
        late = f"list_filter(h, lambda x: x.m = {i} AND x.us > us - 60000000)"
        able.append(
            f"WHEN {spent} * {p['cost']!r}::DOUBLE / 1e6 < {p['limit']!r} AND required_context <= {p['tpr']} "
            f"AND coalesce(list_sum(list_transform({late}, lambda x: x.tok)), 0) + required_context <= {p['tpm']} AND len({late}) + 1 <= {p['rpm']} THEN {i}"
        )
    names = "[" + ", ".join(quote(p["model"]) for p in _scarce()) + "]"
    return f"""WITH RECURSIVE {_ANALYZED}, {_REQUESTS},
  line AS (SELECT request_id, {EPOCH} + request_id * {SHARED_STEP} AS us, tenant || '/' || epoch AS key, required_context, total_tokens,
      row_number() OVER (ORDER BY request_id) AS rn FROM requests),
  walk AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS request_id, 0 AS p, []::STRUCT(us BIGINT, m INT, tok BIGINT, k VARCHAR)[] AS h
    UNION ALL
    SELECT rn, request_id, p, list_append(h, {{'us': us, 'm': greatest(p, 0), 'tok': total_tokens, 'k': key}}) FROM (
      SELECT l.*, w.h, CASE {" ".join(able)} ELSE -1 END AS p FROM walk w JOIN line l ON l.rn = w.rn + 1))
  SELECT request_id, greatest(p, 0) AS preference, {names}[greatest(p, 0) + 1] AS model, p = -1 AS exhausted FROM walk WHERE rn > 0"""


ORACLES = {
    "request_tokens": f"WITH {_ANALYZED} SELECT conv_id, prompt_tokens FROM analyzed",
    "request_complexity": f"WITH {_ANALYZED} SELECT * FROM analyzed",
    "usage_trailing_60s": f"""WITH {_FEED} SELECT event_id, model, CAST(coalesce(sum(tokens) OVER w, 0) AS BIGINT) AS tpm, count(*) OVER w AS rpm FROM feed
        WINDOW w AS (PARTITION BY model ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND INTERVAL '0.000001 seconds' PRECEDING)""",
    "route_candidates": f"WITH {_ROUTED} SELECT request_id, cluster_rank, ord, model, reject_reason FROM cand",
    "route_selected": f"WITH {_ROUTED} {_SELECT}",
    "route_escalated": f"WITH {_ROUTED} SELECT request_id, model, required_context FROM routed WHERE over_limit",
    "route_with_usage": f"WITH {_routed(True)} {_SELECT}",
    "candidates_with_usage": f"WITH {_routed(True)} SELECT request_id, ord, CAST(tpm_used AS BIGINT) AS tpm_used, rpm_used, reject_reason FROM cand",
    "cost_ledger": f"""WITH {_ROUTED}, prices AS (SELECT model, arg_min(cost, ord) AS price FROM endpoints GROUP BY model),
        c AS (SELECT request_id, ts, model, (input_tokens + output_tokens) * coalesce(price, 0.1) / 1e6 AS cost FROM routed LEFT JOIN prices USING (model) WHERE {_STATUS} = 'success')
        SELECT request_id, model, round(cost, 9) AS cost, round(sum(cost) OVER (PARTITION BY model ORDER BY ts, request_id), 9) AS running_spend FROM c""",
    "gateway_metrics": f"""WITH {_ROUTED}, c AS (SELECT *, {_STATUS} AS status FROM routed)
        SELECT count(*) AS total_requests, count(*) FILTER (status = 'success') AS successful_requests, count(*) FILTER (status = 'failed') AS failed_requests,
          CAST(sum(input_tokens) FILTER (status = 'success') AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) FILTER (status = 'success') AS BIGINT) AS total_output_tokens,
          count(*) FILTER (is_fallback AND status <> 'blocked') AS fallback_events FROM c""",
    "provider_calls": f"""WITH {_ROUTED} SELECT model, complexity, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens
        FROM routed WHERE {_STATUS} = 'success' GROUP BY ROLLUP (model, complexity)""",
    "preference_shared": _shared_walk(),
    "gateway_run": f"""WITH {_RUNS} SELECT request_id, status, blocked_by, block_reason, prompt_tokens, CASE WHEN blocked_by IS NULL THEN complexity END AS complexity,
        model, answered_by, failed_over, CASE WHEN status = 'success' THEN round(cost, 9) END AS cost FROM runs""",
    "gateway_run_metrics": f"""WITH {_RUNS} SELECT count(*) AS total_requests, count(*) FILTER (status = 'success') AS successful_requests, count(*) FILTER (status = 'failed') AS failed_requests,
        CAST(coalesce(sum(prompt_tokens) FILTER (status = 'success'), 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(sum({REPLY_TOKENS}) FILTER (status = 'success'), 0) AS BIGINT) AS total_output_tokens,
        CAST(coalesce(sum(CAST(is_fallback AS INT)) FILTER (status <> 'blocked'), 0) + coalesce(sum(CAST(failed_over AS INT)) FILTER (status = 'success'), 0) AS BIGINT) AS fallback_events FROM runs""",
    "gateway_log": f"""WITH {_RUNS}, {_EVENTS}, told AS (SELECT * FROM seen JOIN ends USING (conv_id))
        SELECT conv_id AS request_id, 0 AS step, turn AS pos, 'warning' AS type, 'sanitized' AS code, NULL::VARCHAR AS model, role AS detail FROM told WHERE modified AND NOT blocked AND (pii_end IS NULL OR turn <= pii_end)
        UNION ALL SELECT conv_id, 0, turn, 'warning', 'pii_blocked', NULL, block_reason FROM told WHERE turn = pii_end
        UNION ALL SELECT conv_id, 0, {g.SAFETY_POSITION} + turn, 'warning', CASE WHEN stops THEN 'safety_blocked' ELSE 'safety_logged' END, NULL, guard FROM told
          WHERE rule IS NOT NULL AND pii_end IS NULL AND (safety_end IS NULL OR turn <= safety_end)
        UNION ALL SELECT l.request_id, 1, seq, type, code, l.model, detail FROM log l JOIN runs USING (request_id) WHERE blocked_by IS NULL
        UNION ALL SELECT request_id, 2, 0, 'warning', 'failover', answered_by, model FROM runs WHERE failed_over AND blocked_by IS NULL
        UNION ALL SELECT request_id, 2, 1, 'success', 'answered', answered_by, printf('%.9f', cost) FROM runs WHERE status = 'success'
        UNION ALL SELECT request_id, 2, 1, 'error', 'failed', model, NULL FROM runs WHERE status = 'failed'""",
    "preference_budget": _walk(PREFERRED, LIMITS),
    "preference_budget_narrow": _walk(NARROW_FIRST, NARROW_LIMITS),
    "routing_log": f"WITH {_ROUTED}, {_EVENTS} SELECT request_id, seq, type, code, model, detail FROM log",
    "routing_log_latest": f"WITH {_ROUTED}, {_EVENTS} SELECT request_id, seq, code, model, detail FROM log ORDER BY ts DESC, request_id DESC, seq DESC LIMIT 50",
    "model_catalog": f"""WITH {_ROUTED}, served AS (SELECT id, count(*) AS n FROM (SELECT cluster AS id FROM routed UNION ALL SELECT model FROM routed) GROUP BY id),
        first AS (SELECT id, arg_min(tpm, ord) AS default_tpm, arg_min(cost, ord) / 1000.0 AS price_per_k FROM (SELECT cluster AS id, * FROM endpoints UNION ALL SELECT model AS id, * FROM endpoints) GROUP BY id),
        listed AS (SELECT DISTINCT cluster AS id, 'proxy-system' AS owned_by, 'virtual' AS type, NULL::INTEGER AS ord, NULL::BIGINT AS tpm_limit, NULL::BIGINT AS rpm_limit, NULL::BIGINT AS tpr_limit FROM endpoints
          UNION ALL SELECT model, split_part(model, '/', 1), 'physical', ord, tpm, rpm, tpr FROM endpoints)
        SELECT l.*, CAST(default_tpm AS BIGINT) AS default_tpm, price_per_k, coalesce(n, 0) AS calls FROM listed l JOIN first USING (id) LEFT JOIN served USING (id)""",
    "failover_resolution": f"""WITH {_ROUTED}, steps AS (SELECT c.request_id, c.searched, c.model, c.ord,
          CASE WHEN c.searched = r.selected_cluster AND c.model = r.model THEN 0 WHEN c.searched = r.selected_cluster THEN c.ord
               WHEN c.ord = min(c.ord) OVER (PARTITION BY c.request_id, c.searched) THEN 10000 + c.cluster_rank END AS step
          FROM cand c JOIN routed r USING (request_id)),
        ok AS (SELECT request_id, arg_min(model, step) AS answered_by, arg_min(searched, step) AS answered_cluster, min(step) AS step FROM steps
          WHERE step IS NOT NULL AND (request_id * 31 + ord * 17) % 5 < 1 GROUP BY request_id)
        SELECT request_id, model AS selected_model, answered_by, answered_cluster, CASE WHEN step IS NULL THEN 'failed' ELSE 'success' END AS status,
          coalesce(step > 0, false) AS failed_over FROM routed LEFT JOIN ok USING (request_id)""",
    "session_history": f"""WITH {_ROUTED} SELECT tenant AS session, request_id, row_number() OVER (PARTITION BY tenant ORDER BY ts, request_id) AS turn_number, model,
        request_id % 17 / 10.0 AS latency FROM routed""",
    "latency_summary": f"WITH {_ROUTED} SELECT model, count(*) AS queries, round(avg(request_id % 17 / 10.0), 6) AS mean_latency FROM routed GROUP BY model",
}
