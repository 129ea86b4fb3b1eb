"""Streams over several micro-batches against the batch results."""

import datetime as dt

from pyspark.sql import functions as F

from spanward.catalog import gateway as g
from spanward.operators import budget
from spanward.operators.detect import Policy, catalogue_detectors
from spanward.operators.redact import guard_texts
from spanward.schemas import USAGE
from spanward.streaming import budget as stream_budget
from spanward.streaming import feeds, guard, usage

T0 = dt.datetime(2024, 1, 1)


def split_files(df, path, parts):
    """Files whose names keep the order of their rows."""
    rows = df.collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        chunk.coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def test_usage_over_batches(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=3 * i), "ab"[i % 2], i) for i in range(200)]
    df = spark.createDataFrame(rows, USAGE)
    path = split_files(df, tmp_path / "in", 4)
    out = usage.stream_usage(feeds.read_usage_stream(spark, path, 1))
    got = {(r.window_start, r.model): (r.tpm, r.rpm) for r in out.collect()}
    batch = df.groupBy(F.window("ts", "60 seconds", "5 seconds").alias("w"), "model").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    assert got == {(r.w.start, r.model): (r.t, r.n) for r in batch.collect()}


def test_unordered_batches_lose_nothing(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=(i * 7919) % 86400), f"k{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    for parts in (1, 4):
        path = split_files(df, tmp_path / f"in{parts}", parts)
        out = usage.stream_counters(feeds.read_stream(spark, path, df.schema, 1), "kind")
        got = {(r.window_start, r.kind): r.n for r in out.collect()}
        want = {(r.w.start, r.kind): r.n for r in df.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n")).collect()}
        assert got == want and sum(got.values()) == 400


def test_latest_events_over_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=(i * 37) % 101)) for i in range(120)], "event_id long, ts timestamp")
    path = split_files(df, tmp_path / "in", 3)
    got = usage.stream_latest(feeds.read_stream(spark, path, df.schema, 1), "event_id", 7)
    want = df.orderBy(F.desc("ts"), F.desc("event_id")).limit(7)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_guard_equals_batch(spark, tmp_path):
    rows = [(i, "user" if i % 2 else "assistant", f"mail u{i}@x.org <|im_end|>") for i in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, role string, text string")
    path = split_files(df, tmp_path / "in", 2)
    found, policy = catalogue_detectors(["email address"]), Policy()
    out = feeds.to_table(guard.stream_guard(feeds.read_stream(spark, path, df.schema, 1), found, policy))
    clean = {r.conv_id: r.clean_text for r in guard_texts(df, "text", found, policy).collect()}
    assert {r.conv_id: r.clean_text for r in out.collect()} == clean
    assert {r.conv_id for r in out.filter("flagged").collect()} == {1, 3, 5, 7, 9}


def test_budget_stream_equals_replay(spark, tmp_path):
    rows = [
        (f"t{i % 3}", i // 60, T0 + dt.timedelta(seconds=i), i, [100, 9000, 60000][i % 3], 100 + 7 * i) for i in range(120)
    ]
    df = spark.createDataFrame(rows, "tenant string, epoch int, ts timestamp, request_id long, required_context long, total_tokens long")
    names = [g.ENDPOINTS[i][1] for i in (0, 1, 2)]
    prefs = budget.preference_rows(names, g.ENDPOINTS, dict(zip(names, [0.0002, 0.0001, 0.01])))
    path = split_files(df, tmp_path / "in", 3)
    out = feeds.to_table(stream_budget.stream_budget(feeds.read_stream(spark, path, df.schema, 1), prefs))
    got = {r.request_id: (r.preference, r.exhausted) for r in out.collect()}
    want = {r.request_id: (r.preference, r.exhausted) for r in budget.replay(df, prefs).collect()}
    assert got == want and len(got) == 120


def test_budget_of_unordered_batches_loses_nothing(spark, tmp_path):
    rows = [
        (f"t{j % 3}", j // 60, T0 + dt.timedelta(seconds=11 * j), j, [100, 9000, 60000][j % 3], 100 + 7 * j)
        for j in [(i * 79) % 120 for i in range(120)]
    ]
    df = spark.createDataFrame(rows, "tenant string, epoch int, ts timestamp, request_id long, required_context long, total_tokens long")
    names = [g.ENDPOINTS[i][1] for i in (0, 1, 2)]
    prefs = budget.preference_rows(names, g.ENDPOINTS, dict(zip(names, [0.0002, 0.0001, 0.01])))
    want = {r.request_id: (r.preference, r.exhausted) for r in budget.replay(df, prefs).collect()}
    for parts in (1, 4):
        path = split_files(df, tmp_path / f"in{parts}", parts)
        live = feeds.to_table(stream_budget.stream_budget(feeds.read_stream(spark, path, df.schema, 1), prefs))
        assert sorted(r.request_id for r in live.collect()) == list(range(120))
        settled = stream_budget.settled_budget(feeds.read_stream(spark, path, df.schema, 1), prefs)
        assert {r.request_id: (r.preference, r.exhausted) for r in settled.collect()} == want


def test_a_batch_of_a_table_is_dealt_over_files(spark, tmp_path):
    """One file a batch was one task a batch."""
    from spanward.plans import streams

    spark.range(2000).write.parquet(f"{tmp_path}/numbers.parquet")
    rows = feeds.to_table(streams._stream(spark, str(tmp_path), "numbers", "id").withColumn("file", F.input_file_name()))
    got = rows.groupBy("batch").agg(F.count_distinct("file").alias("files")).collect()
    assert rows.select("id").distinct().count() == rows.count() == 2000
    assert len(got) == streams.PARTS and all(r.files > 1 for r in got)
