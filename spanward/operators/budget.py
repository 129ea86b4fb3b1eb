"""Preference routing under credit limits.

Spend only grows, so a tenant passes through at most one phase per preference: within a phase
the set of open preferences is fixed and each request's choice depends on its own context size
alone. A phase ends with the request whose cost makes an open preference reach its limit.
That turns the sequential walk into one distributed prefix sum per preference, exact for any
limits and context sizes, and a tenant may hold any share of the rows.

Live rate limits open and close again and have no such phases; ``replay`` walks the requests
of a tenant in order for them.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import gateway as g
from ..functions.scale import SLICE, slice_offsets, sliced, within_slice
from ..session import materialise, ship

KEYS = ["tenant", "epoch"]
ORDER = ["ts", "request_id"]


def preference_rows(preferences: list[str], endpoints: list[tuple], limits: dict | None = None) -> list[dict]:
    """Preferences with the limits of the first endpoint of that model; unknown models are skipped.

    ``held``: when all are exhausted the very first preference is taken; if that one is unknown, none is, and the
    request goes on to the search of its cluster.
    """
    first: dict = {}
    for cluster, model, rpm, tpm, tpr, cost, _ in endpoints:
        first.setdefault(model, {"model": model, "cluster": cluster, "rpm": rpm, "tpm": tpm, "tpr": tpr, "cost": cost})
    limits = limits or {}
    held = bool(preferences) and preferences[0] in first
    known = [dict(first[m], limit=float(limits.get(m, g.DEFAULT_CREDIT_LIMIT)), held=held) for m in preferences if m in first]
    if not known:
        raise ValueError("no preferred model is configured")
    return known


def choose(context: Column, open_: list[Column], prefs: list[dict]) -> Column:
    """First open preference wide enough; when all are exhausted the first one, or null if it is unknown."""
    fits = [F.when(o & (context <= p["tpr"]), F.lit(i)) for i, (o, p) in enumerate(zip(open_, prefs))]
    return F.coalesce(*fits, F.lit(0) if prefs[0].get("held", True) else F.lit(None).cast("int"))


def _costs(prefs: list[dict], chosen: Column) -> Column:
    rate = F.element_at(F.array(*[F.lit(p["cost"] / 1e6) for p in prefs]), chosen + 1)
    return F.col("total_tokens") * rate


def route_by_preference(requests: DataFrame, prefs: list[dict]) -> DataFrame:
    """Add preference (index), model, cluster and exhausted to requests.

    ``requests``: tenant, epoch (number of spend resets so far), ts, request_id,
    required_context, total_tokens.
    """
    k = len(prefs)
    rows = sliced(requests, KEYS, ORDER)
    keyed = rows.select(*KEYS, SLICE).distinct()
    state_cols = [c for i in range(k) for c in (f"open_{i}", f"spent_{i}")]
    state = keyed.select(
        *KEYS, SLICE,
        F.array().cast("array<struct<end_ts:timestamp,end_id:bigint,open:array<boolean>>>").alias("phases"),
        F.lit(None).cast("timestamp").alias("from_ts"),
        F.lit(None).cast("bigint").alias("from_id"),
        *[
            c
            for i, p in enumerate(prefs)
            for c in (F.lit(p["limit"] > 0).alias(f"open_{i}"), F.lit(0.0).alias(f"spent_{i}"))
        ],
    )
    for _ in range(k):
        state = materialise(_next_phase(rows, state, prefs, state_cols), "phases")

    here = F.struct(F.col("ts").alias("t"), F.col("request_id").alias("r"))
    in_phase = F.filter(
        "phases",
        lambda p: p["end_ts"].isNull()
        | (F.struct(p["end_ts"].alias("t"), p["end_id"].alias("r")) >= here),
    )
    last_open = F.array(*[F.col(f"open_{i}") for i in range(k)])
    opened = F.coalesce(F.try_element_at(in_phase, F.lit(1))["open"], last_open)
    out = rows.join(state, [*KEYS, SLICE]).withColumn("_open", opened)
    flags = [F.element_at("_open", i + 1) for i in range(k)]
    fits = F.lit(False)
    for flag, p in zip(flags, prefs):
        fits = fits | (flag & (F.col("required_context") <= p["tpr"]))
    out = out.withColumns({"preference": choose(F.col("required_context"), flags, prefs), "exhausted": ~fits})

    def named(field):
        return F.when(F.col("preference").isNotNull(), F.element_at(F.array(*[F.lit(p[field]) for p in prefs]), F.col("preference") + 1))

    return out.select(
        *requests.columns, "preference", named("model").alias("model"), named("cluster").alias("cluster"),
        "exhausted",
    )


def _next_phase(rows: DataFrame, state: DataFrame, prefs: list[dict], state_cols: list[str]) -> DataFrame:
    """Close the phase that is running in each (tenant, epoch).

    ``state`` has one small row per (tenant, epoch, slice) so that it joins the rows on their
    own partitioning, whatever share a tenant has.
    """
    k = len(prefs)
    here = F.struct(F.col("ts").alias("t"), F.col("request_id").alias("r"))
    begun = F.struct(F.col("from_ts").alias("t"), F.col("from_id").alias("r"))
    live = rows.select(*KEYS, SLICE, *ORDER, "required_context", "total_tokens").join(
        state.drop("phases"), [*KEYS, SLICE]
    ).filter(F.col("from_ts").isNull() | (here > begun))
    live = live.withColumn(
        "chosen", choose(F.col("required_context"), [F.col(f"open_{i}") for i in range(k)], prefs)
    )
    live = live.withColumns(
        {f"cost_{i}": F.when(F.col("chosen") == i, _costs(prefs, F.lit(i))).otherwise(0.0) for i in range(k)}
    )
    sums = {f"run_{i}": F.col(f"cost_{i}") for i in range(k)}
    w = within_slice(KEYS, ORDER)
    summed = live.withColumns({f"in_{n}": F.sum(c).over(w) for n, c in sums.items()}).join(
        slice_offsets(live, KEYS, sums), [*KEYS, SLICE]
    )
    spent = [F.col(f"spent_{i}") + F.col(f"_before_run_{i}") + F.col(f"in_run_{i}") for i in range(k)]
    reached = F.lit(False)
    for i, p in enumerate(prefs):
        reached = reached | (F.col(f"open_{i}") & (spent[i] >= p["limit"]))
    ends = (
        summed.filter(reached)
        .groupBy(*KEYS)
        .agg(F.min(F.struct("ts", "request_id", *[s.alias(f"now_{i}") for i, s in enumerate(spent)])).alias("end"))
    )
    out = state.join(ends, KEYS, "left")
    ended = F.col("end").isNotNull()
    phase = F.struct(
        F.col("end.ts").alias("end_ts"),
        F.col("end.request_id").alias("end_id"),
        F.array(*[F.col(f"open_{i}") for i in range(k)]).alias("open"),
    )
    grown = F.when(ended, F.concat("phases", F.array(phase))).otherwise(F.col("phases"))
    cols = {
        "phases": grown,
        "from_ts": F.coalesce("end.ts", "from_ts"),
        "from_id": F.coalesce("end.request_id", "from_id"),
    }
    for i, p in enumerate(prefs):
        now = F.coalesce(F.col(f"end.now_{i}"), F.col(f"spent_{i}"))
        cols[f"spent_{i}"] = now
        cols[f"open_{i}"] = F.col(f"open_{i}") & (now < p["limit"])
    return out.select(
        *KEYS, SLICE,
        *[cols[c].alias(c) if c in cols else F.col(c) for c in ["phases", "from_ts", "from_id", *state_cols]],
    )


class Walk:
    """Spend and trailing usage of one tenant, advanced request by request."""

    def __init__(self, prefs: list[dict], spend: dict | None = None, recent=()):
        self.prefs = prefs
        self.spend = dict(spend or {})
        self.recent = deque(recent)
        self.used: dict = {}
        for _, model, tokens in self.recent:
            self._use(model, tokens, 1)

    def _use(self, model: str, tokens: int, calls: int) -> None:
        before = self.used.get(model, (0, 0))
        self.used[model] = (before[0] + tokens, before[1] + calls)

    def take(self, at: int, context: int, total_tokens: int) -> tuple[int | None, bool]:
        """Index of the preference taken, if any, and whether all were exhausted; ``at`` in microseconds."""
        horizon = at - g.USAGE_WINDOW_SECONDS * 1_000_000
        while self.recent and self.recent[0][0] <= horizon:
            _, model, tokens = self.recent.popleft()
            self._use(model, -tokens, -1)
        chosen = None
        for i, p in enumerate(self.prefs):
            tokens, calls = self.used.get(p["model"], (0, 0))
            within = (
                self.spend.get(p["model"], 0.0) < p["limit"]
                and context <= p["tpr"]
                and tokens + context <= p["tpm"]
                and calls + 1 <= p["rpm"]
            )
            if within:
                chosen = i
                break
        if chosen is None and not self.prefs[0].get("held", True):
            return None, True
        index = 0 if chosen is None else chosen
        p = self.prefs[index]
        self.spend[p["model"]] = self.spend.get(p["model"], 0.0) + total_tokens * p["cost"] / 1e6
        self.recent.append((at, p["model"], total_tokens))
        self._use(p["model"], total_tokens, 1)
        return index, chosen is None


def replay(requests: DataFrame, prefs: list[dict]) -> DataFrame:
    """Exact walk with credit, context, token-rate and request-rate limits.

    Rows arrive sorted by tenant and time and are read batch by batch: a task holds one Arrow
    batch and one tenant's last minute, never a tenant's whole history. A new epoch clears the
    spend but not the rates.
    """
    fields = [f for f in requests.schema.fields if f.name not in ("preference", "model", "exhausted")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema += ", preference int, model string, exhausted boolean"
    names = [f.name for f in fields]

    def walk(batches):
        tenant, epoch, state = None, None, None
        for pdf in batches:
            at = pdf["ts"].astype("datetime64[us, UTC]" if pdf["ts"].dt.tz else "datetime64[us]").astype("int64")
            picked, spent = [], []
            for t, e, a, c, n in zip(pdf["tenant"], pdf["epoch"], at, pdf["required_context"], pdf["total_tokens"]):
                if state is None or t != tenant:
                    tenant, epoch, state = t, e, Walk(prefs)
                elif e != epoch:
                    epoch = e
                    state.spend.clear()
                i, x = state.take(int(a), int(c), int(n))
                picked.append(i)
                spent.append(x)
            out = pdf[names].copy()
            out["preference"] = pd.array(picked, dtype="Int32")
            out["model"] = [None if i is None else prefs[i]["model"] for i in picked]
            out["exhausted"] = spent
            yield out

    ship(requests.sparkSession)
    ordered = requests.select(*names).repartition("tenant").sortWithinPartitions("tenant", *ORDER)
    return ordered.mapInPandas(walk, schema)
