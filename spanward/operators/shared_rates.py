"""Preference routing with credit limits per tenant and live rates per model that all tenants share.

A request's choice depends on earlier requests only: on what its tenant has spent and on how much of each model everybody
used in the minute before. Time is cut into slices. In a round, every slice is walked at once, from what the last round
says of earlier slices: the uses of the minute before it, and each tenant's spend so far. What stands before the first
change of a round was right, so the slice of that change is right now: all up to it are settled, written once and walked
no more. This ends, after as many rounds as there are slices at most, in what one walk in order of time gives.

Spend and scarce rates may hand an early difference on for ever, and then each round settles one slice. A round costs
seconds whatever it walks, so slices are no more than their rows ask for (``SLICE_ROWS``; a few at least), nor more than
the session's shuffle partitions. A task holds an Arrow batch, a minute of uses and the tenants met in its slice; no tenant, model or
minute is one task, and each round is written.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.gateway import USAGE_WINDOW_SECONDS
from ..functions.scale import SLICE, slice_offsets, sliced
from ..session import fresh_path, materialise, ship, slices
from .budget import KEYS, ORDER

#: Rows that a slice is cut for: a walk over them takes less time than the jobs of a round.
SLICE_ROWS = 4096
#: Slices of small inputs, so that no one task has them all.
LEAST_SLICES = 4
_SPAN = USAGE_WINDOW_SECONDS * 1_000_000
_STATE = f"{SLICE} int, request_id bigint, at bigint, tenant string, epoch string, total_tokens bigint, preference int, exhausted boolean, _before int"


class SharedWalk:
    """Uses of the last minute by everybody and spend by tenant, in order of time."""

    def __init__(self, prefs: list[dict]):
        self.prefs, self.recent = prefs, deque()
        self.used: dict = defaultdict(lambda: [0, 0])
        self.spent: dict = defaultdict(lambda: defaultdict(int))

    def use(self, at: int, model: str, tokens: int) -> None:
        self.recent.append((at, model, tokens))
        self.used[model][0] += tokens
        self.used[model][1] += 1

    def choose(self, at: int, key: tuple, before: dict, context: int) -> int | None:
        """``before``: tokens of each model that the tenant had before this slice."""
        while self.recent and self.recent[0][0] <= at - _SPAN:
            _, model, tokens = self.recent.popleft()
            self.used[model][0] -= tokens
            self.used[model][1] -= 1
        own = self.spent[key]
        for i, p in enumerate(self.prefs):
            m = p["model"]
            spend = (before[m] + own[m]) * p["cost"] / 1e6
            tokens, calls = self.used[m]
            if spend < p["limit"] and context <= p["tpr"] and tokens + context <= p["tpm"] and calls + 1 <= p["rpm"]:
                return i
        return None


def _walked(prefs: list[dict]):
    held, models = prefs[0].get("held", True), [p["model"] for p in prefs]

    def run(batches):
        current, walk = None, None
        for pdf in batches:
            out = []
            sums = [pdf[f"_before_spent_{i}"] for i in range(len(prefs))]
            columns = [pdf[c] for c in (SLICE, "past", "at", "request_id", "tenant", "epoch", "required_context", "total_tokens", "preference")]
            for s, past, at, request, tenant, epoch, context, tokens, was, *spent in zip(*columns, *sums):
                if s != current:
                    current, walk = s, SharedWalk(prefs)
                if past:
                    walk.use(int(at), models[int(was)], int(tokens))
                    continue
                before: dict = defaultdict(int)
                for m, x in zip(models, spent):
                    before[m] += int(x)
                chosen = walk.choose(int(at), (tenant, epoch), before, int(context))
                taken = 0 if chosen is None and held else chosen
                if taken is not None:
                    walk.use(int(at), models[taken], int(tokens))
                    walk.spent[tenant, epoch][models[taken]] += int(tokens)
                out.append((s, request, at, tenant, epoch, tokens, taken, chosen is None, None if was < 0 else int(was)))
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in _STATE.split(", ")])
            for c in ("preference", "_before"):
                frame[c] = pd.array(frame[c], dtype="Int32")
            yield frame

    return run


def route_shared(requests: DataFrame, prefs: list[dict], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(request_id, preference, model, exhausted, rounds) of every request.

    ``requests``: tenant, epoch, ts, request_id (unique), required_context, total_tokens. A request that finds no
    preference within its limits takes the first one, or none if that is not configured (``held``). Spend is exact: it
    is counted in tokens and priced once.
    """
    spark, k = requests.sparkSession, len(prefs)
    ship(spark)
    needed = requests.select(
        *[F.col(c).cast("string").alias(c) for c in KEYS], *ORDER, F.unix_micros("ts").alias("at"),
        F.col("required_context").cast("long").alias("required_context"), F.col("total_tokens").cast("long").alias("total_tokens"),
    )
    needed = materialise(needed, "requests")
    n = min(slices(spark), max(LEAST_SLICES, math.ceil(needed.count() / slice_rows)))
    rows = sliced(needed, [], ORDER, n)
    starts = [(r[SLICE], r.at) for r in rows.groupBy(SLICE).agg(F.min("at").alias("at")).orderBy(SLICE).collect()]  # one a slice

    guess = F.coalesce(*[F.when(F.col("required_context") <= p["tpr"], F.lit(i)) for i, p in enumerate(prefs)], F.lit(0))
    state = rows.select(SLICE, "request_id", "at", *KEYS, "total_tokens", guess.alias("preference"))
    path, rounds, open_ = fresh_path(spark, "settled"), 0, starts
    while open_:
        rounds += 1
        later = F.array(*[F.struct(F.lit(s).alias("slice"), F.lit(a).cast("long").alias("at")) for s, a in open_])
        counted = {f"spent_{i}": F.when(F.col("preference") == i, F.col("total_tokens")).otherwise(F.lit(0).cast("long")) for i in range(k)}
        spent = slice_offsets(state, KEYS, counted)
        none = {f"_before_spent_{i}": F.lit(0).cast("long") for i in range(k)}
        unsettled = rows.where(F.col(SLICE) >= open_[0][0])
        here = unsettled.join(spent, [*KEYS, SLICE]).join(state.select("request_id", "preference"), "request_id").select(
            SLICE, F.lit(False).alias("past"), "at", "request_id", *KEYS, "required_context", "total_tokens",
            F.coalesce("preference", F.lit(-1)).alias("preference"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in none],
        )
        behind = F.filter(later, lambda s: (s["slice"] > F.col(SLICE)) & (s["at"] < F.col("at") + _SPAN))
        near = state.where((F.col("at") > open_[0][1] - _SPAN) & F.col("preference").isNotNull())
        carried = near.select(
            F.explode(F.transform(behind, lambda s: s["slice"])).alias(SLICE), F.lit(True).alias("past"), "at", "request_id", *KEYS,
            F.lit(0).cast("long").alias("required_context"), "total_tokens", "preference", *[c.alias(n) for n, c in none.items()],
        )
        line = here.unionByName(carried).repartition(len(open_), SLICE).sortWithinPartitions(SLICE, F.desc("past"), "at", "request_id")
        made = materialise(line.mapInPandas(_walked(prefs), _STATE), "choices")
        changed = made.where("NOT (preference <=> _before)").agg(F.min(SLICE)).first()[0]
        last = open_[-1][0] if changed is None else changed
        made.where(F.col(SLICE) <= last).drop("_before").write.mode("append").parquet(path)
        settled = spark.read.schema(made.drop("_before").schema).parquet(path)
        open_ = [(s, a) for s, a in open_ if s > last]
        state = settled.unionByName(made.where(F.col(SLICE) > last).drop("_before")).drop("exhausted")
    made = settled if starts else state.withColumn("exhausted", F.lit(False))
    model = F.element_at(F.array(*[F.lit(p["model"]) for p in prefs]), F.col("preference") + 1)
    return made.select("request_id", "preference", F.when(F.col("preference").isNotNull(), model).alias("model"), "exhausted", F.lit(rounds).alias("rounds"))
