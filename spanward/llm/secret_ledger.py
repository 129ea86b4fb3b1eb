"""Secrets in all versions of all texts, found once per content, by an incremental blob ledger.

A version of a text is named by the SHA-256 of its bytes. The ledger is a Parquet table in a shared folder with one row
per scan of a blob: the rules it was scanned by, each with its version, and the spans found. A run asks the ledger which
(blob, rule version) pairs it has not seen, scans only those, appends them in one write and joins the findings of the
current rules back to every path that holds the blob. New versions of old contents, moved paths and copies so cost a
hash; a changed rule costs one scan per blob by that rule alone.

Copies leave a task once, compressed, so a text that a third of all rows share is a row per task. A scan holds one text.
A run that dies before its append leaves the ledger as it was; pairs that two runs scanned at once count once.

Defined cases: a null text is the empty one and has no findings; repeated rows are paths of their own, with equal
findings; a text of any length is scanned whole; no rows give no rows; only the path columns and the text are read, so
other columns may have any names (path columns must not be called ``blob`` or ``found``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, prepare, ship
from .arrow import row_slices, unpacked

EVENTS = "blob binary, rules array<string>, found array<struct<rule:string,start:int,end:int>>"
SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"
#: Texts that a scan unpacks at a time.
AT_ONCE = 32


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` whose ``group`` has ``least`` characters or more; a change needs a new ``version``.

    Every match holds one of ``hints`` (lower case), which are looked for first.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    hints: tuple[str, ...] = ()
    any_case: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule(
        "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, group=2, any_case=True,
        hints=("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18, hints=("akia",)),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # runs are maximal, so shorter ones are dropped by the pattern
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\r\n]*", 1, hints=("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, hints=("eyj",)),
    Rule("url_login", r"://[^\x00-\x20:/@]+:([^\x00-\x20:/@]+)@", 1, group=1, hints=("://",)),
)
RULES = BASE + ADDED


def compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def spans_of(text: str, rules: list[tuple[Rule, re.Pattern]]) -> Iterator[tuple[str, int, int]]:
    """(rule, start, end) in code points; the span is the whole match."""
    low = text.lower()
    for rule, pattern in rules:
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                yield rule.name, m.start(), m.end()


class Ledger:
    """What has been scanned by which rules, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = prepare(spark), path
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ", 1) for x in EVENTS.split(", "))]
        spark.range(0).select(*nothing).write.mode("ignore").parquet(path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(self.path)

    def append(self, events: DataFrame) -> None:
        events.write.mode("append").parquet(self.path)

    def seen(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, seen): which of ``rules`` each blob was scanned by."""
        pairs = self.events().select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.name for r in rules]))
        return pairs.groupBy("blob").agg(F.collect_set("rule").alias("seen"))

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, found) of blobs with findings by ``rules``, sorted by start, then by place in ``rules``."""
        order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
        hits = self.events().select("blob", F.explode("found").alias("f")).where(F.col("f.rule").isin([r.name for r in rules]))
        span = F.struct(
            F.col("f.start").alias("start"), order[F.col("f.rule")].alias("ord"),
            F.substring_index("f.rule", "@", 1).alias("kind"), F.col("f.end").alias("end"),
        )
        return hits.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("found"))


def address(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, body): each blob of the task once, compressed."""
    import zstandard

    pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
    for batch in row_slices(batches, "text"):
        blobs, at = batch.column(0).to_pylist(), []
        for i, blob in enumerate(blobs):
            if blob not in seen:
                seen.add(blob)
                at.append(i)
        texts = batch.column(1).take(pa.array(at, pa.int64())).to_pylist()
        bodies = [pack((t or "").encode()) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array([blobs[i] for i in at], pa.binary()), pa.array(bodies, pa.binary())], ["blob", "body"])


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {r.name: (r, compiled(r)) for r in rules}
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                found = []
                for body, todo in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    text = unpacked(body).decode("utf-8", "replace")
                    found.append([{"rule": n, "start": a, "end": b} for n, a, b in spans_of(text, [ready[n] for n in todo])])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, kind)], ["blob", "rules", "found"])

    return run


def unseen(addressed: DataFrame, ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, todo): the rules each blob has still to be scanned by."""
    every = F.array(*[F.lit(r.name) for r in rules])
    left = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    todo = addressed.select("blob").distinct().join(ledger.seen(rules), "blob", "left").select("blob", left.alias("todo"))
    return todo.where(F.size("todo") > 0)


def scan(
    versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, paths: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """(paths, blob, found) of every version; what the ledger lacks is scanned and appended to it first."""
    spark = versions.sparkSession
    ship(spark)
    addressed = materialise(versions.select(*paths, address(text).alias("blob")), "addresses")
    todo = materialise(unseen(addressed, ledger, rules), "unseen")  # its size is known to the join below
    bodies = versions.select(address(text).alias("blob"), F.col(text).alias("text")).mapInArrow(_once_a_task, "blob binary, body binary")
    new = bodies.join(todo, "blob").dropDuplicates(["blob"]).select("blob", "body", "todo")
    ledger.append(new.mapInArrow(_scan(rules), EVENTS))
    found = materialise(ledger.findings(rules), "findings")
    return addressed.join(found, "blob", "left").select(*paths, "blob", F.coalesce("found", F.expr(f"cast(array() AS {SPANS})")).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base rules' spans, and all spans as text."""
    def of(*kinds: str) -> Column:
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    base = of(*[r.kind for r in BASE])
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return scanned.select(id_col, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
