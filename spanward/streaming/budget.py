"""Preference routing on a stream: spend and the last minute's usage as keyed state.

``stream_budget`` answers every request in the batch that brings it. There is no watermark, so none is dropped: one that
comes late takes part in the spend of its own epoch and meets the rates at the newest time its tenant has reached. Its
answers so depend on the order of arrival; ``settled_budget`` gives those of the order in time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.budget import Walk, replay
from ..session import fresh_path, ship
from .feeds import run_available

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "tenant string, request_id bigint, preference int, model string, exhausted boolean"


class BudgetState(StatefulProcessor):
    """Per tenant: spend per epoch and model, and usage records of the last minute."""

    def __init__(self, prefs: list[dict]):
        self.prefs = prefs

    def init(self, handle) -> None:
        self.spend = handle.getMapState("spend", "epoch bigint, model string", "spent double")
        self.recent = handle.getListState("recent", "at bigint, model string, tokens bigint")
        self.newest = handle.getValueState("newest", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        """Requests of one micro-batch in time order; the batch size bounds what is sorted."""
        pdf = pd.concat(list(rows)).sort_values(["ts", "request_id"], kind="stable")
        spend: dict[int, dict] = {}
        for k, v in self.spend.iterator():
            spend.setdefault(k[0], {})[k[1]] = v[0]
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        newest = self.newest.get()[0] if self.newest.exists() else None
        walk = Walk(self.prefs, None, recent)
        picked, drained = [], []
        at = pdf["ts"].astype("datetime64[us]" if pdf["ts"].dt.tz is None else "datetime64[us, UTC]").astype("int64")
        for e, a, c, n in zip(pdf["epoch"], at, pdf["required_context"], pdf["total_tokens"]):
            newest = int(a) if newest is None else max(newest, int(a))
            walk.spend = spend.setdefault(int(e), {})
            index, spent = walk.take(newest, int(c), int(n))
            picked.append(index)
            drained.append(spent)
        self.newest.update((newest,))
        for e in {int(e) for e in pdf["epoch"]}:
            for model, value in spend[e].items():
                self.spend.updateValue((e, model), (value,))
        self.recent.clear()
        if walk.recent:
            self.recent.put([(int(a), m, int(n)) for a, m, n in walk.recent])
        yield pd.DataFrame(
            {
                "tenant": key[0],
                "request_id": pdf["request_id"].to_numpy(),
                "preference": pd.array(picked, dtype="Int32"),
                "model": [None if i is None else self.prefs[i]["model"] for i in picked],
                "exhausted": drained,
            }
        )

    def close(self) -> None:
        pass


def stream_budget(requests: DataFrame, prefs: list[dict]) -> DataFrame:
    """Requests (tenant, epoch, ts, request_id, required_context, total_tokens) with the choice made."""
    spark = requests.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return requests.groupBy("tenant").transformWithStateInPandas(
        statefulProcessor=BudgetState(prefs),
        outputStructType=OUTPUT,
        outputMode="append",
        timeMode="None",
    )


def settled_budget(requests: DataFrame, prefs: list[dict]) -> DataFrame:
    """The choices for everything that the stream holds, after its last batch.

    Batches are kept as they come, a repeated one replaces its own folder, and the walk is made in the order of time: the
    result depends neither on how rows are cut into batches nor on their order.
    """
    spark = requests.sparkSession
    path = fresh_path(spark, "requests-by-batch")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:09d}")

    run_available(requests, "append", sink)
    kept = spark.read.schema(requests.schema).option("recursiveFileLookup", "true").parquet(path)
    return replay(kept, prefs).select("tenant", "request_id", "preference", "model", "exhausted")
