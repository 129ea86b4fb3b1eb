"""Detection of personal data, canonical labels and the policy applied to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import pii
from ..functions.regex import sql_literal
from ..functions.spans import NO_ENTITIES, flatten, found_entities, lookup, name, resolve_sql
from ..schemas import ENTITIES, POLICY
from ..session import small_table


@dataclass(frozen=True)
class Detector:
    """A pattern with the label it yields and a constant confidence."""

    label: str
    pattern: str
    score: float = 1.0
    name: str = "catalogue"


def catalogue_detectors(labels: list[str] | None = None, scores: dict | None = None) -> list[Detector]:
    """Detectors for catalogue labels; all of them by default."""
    wanted = pii.DETECTION_LABELS if labels is None else labels
    return [
        Detector(label, pattern, (scores or {}).get(label, 1.0))
        for label, pattern in pii.PATTERNS.items()
        if label in wanted
    ]


@dataclass(frozen=True)
class Policy:
    """Action per label; a label that is not listed gets ``default_action`` (None: opt-in only)."""

    actions: dict = field(default_factory=dict)
    default_action: str | None = pii.DEFAULT_ACTION

    def action(self, label: Column) -> Column:
        return lookup(label, self.actions, F.lit(self.default_action).cast("string"))

    def admits(self, label: str) -> bool:
        """Labels without any action are not detected at all."""
        return self.default_action is not None or label in self.actions

    def frame(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, sorted(self.actions.items()), POLICY)


def load_policy(
    policy: dict | None = None, action: str = pii.DEFAULT_ACTION, custom_labels: list[str] = ()
) -> Policy:
    """The explicit map if given, else one action for every default and custom label."""
    if policy is not None:
        return Policy(dict(policy), action)
    names = pii.DEFAULT_LABELS + [c.lower().replace("_", " ") for c in custom_labels]
    return Policy({name: action for name in names}, action)


def detected(
    text: str,
    detectors: list[Detector],
    threshold: float = pii.DEFAULT_THRESHOLD,
    policy: Policy | None = None,
    target: str | None = None,
    overlaps: bool = False,
) -> Column:
    """Entities of one text sorted by start, overlaps resolved unless they are asked for."""
    policy = Policy() if policy is None else policy
    usable = [
        (d.label, d.pattern, d.score) for d in detectors if d.score >= threshold and policy.admits(d.label)
    ]
    if not usable:
        return F.expr(NO_ENTITIES)
    return found_entities(F.col(name(text)), usable, None if target is None else F.col(name(target)), overlaps)


def with_entities(df: DataFrame, text: str, detectors: list[Detector], **options) -> DataFrame:
    return df.withColumn("entities", detected(text, detectors, **options))


def exploded(df: DataFrame, *ids: str, column: str = "entities") -> DataFrame:
    """Long form: one row per span."""
    return flatten(df, column, "_e", *ids).select(*ids, "_e.*")


def detect(df: DataFrame, id_col: str, text: str, detectors: list[Detector], **options) -> DataFrame:
    return exploded(with_entities(df, text, detectors, **options), id_col)


def scan_catalog(
    df: DataFrame,
    id_col: str,
    text: str,
    labels: list[str] | None = None,
    exclude: Column | None = None,
) -> DataFrame:
    """Every catalogue pattern except the row's own label, overlapping hits included."""
    detectors = catalogue_detectors(list(pii.PATTERNS) if labels is None else labels)
    hits = df.withColumn("entities", detected(text, detectors, overlaps=True))
    if exclude is None:
        return exploded(hits, id_col)
    rows = exploded(hits.withColumn("_own", F.coalesce(F.lower(exclude), F.lit(""))), id_col, "_own")
    return rows.filter(F.col("label") != F.col("_own")).drop("_own")


def canonical_sql(label: str, custom: list[str] = ()) -> str:
    """Canonical name of a model label.

    Custom labels are kept (underscores become spaces); others go through the ordered
    fragment rules and, if none applies, are only lower-cased.
    """

    def squeeze(label_name: str) -> str:
        return label_name.upper().replace("_", "").replace(" ", "")

    bare = f"(CASE WHEN {label} LIKE 'B-%' OR {label} LIKE 'I-%' THEN substring({label}, 3) ELSE {label} END)"
    squeezed = f"translate(upper({bare}), '_ ', '')"
    whens = ""
    if custom:
        own = ", ".join(sql_literal(c) for c in sorted({squeeze(c) for c in custom}))
        whens = f"WHEN {squeezed} IN ({own}) THEN replace(lower({bare}), '_', ' ') "
    for fragments, name_ in pii.CANONICAL_RULES:
        hit = " OR ".join(f"contains({squeezed}, '{x}')" for x in fragments)
        whens += f"WHEN {hit} THEN {sql_literal(name_)} "
    return f"CASE {whens} ELSE lower({bare}) END"


def canonical(column: str, custom: list[str] = ()) -> Column:
    return F.expr(canonical_sql(name(column), custom))


def canonicalize(df: DataFrame, label_col: str, custom: list[str] = (), out: str = "canonical_label"):
    """Row-local: the rules are one expression, so no dimension has to be built or joined."""
    return df.withColumn(out, canonical(label_col, custom))


def block_report(df: DataFrame, id_col: str, policy: Policy) -> DataFrame:
    """(id, blocked, reason): spans of one text live in one row, so nothing is shuffled."""
    labels = blocked_labels(F.col("entities"), policy)
    return df.select(id_col, (F.size(labels) > 0).alias("blocked"), block_reason(labels).alias("reason"))


def blocked_labels(entities: Column, policy: Policy) -> Column:
    names = F.transform(
        F.filter(entities, lambda e: policy.action(e["label"]) == "BLOCK"), lambda e: e["label"]
    )
    return F.sort_array(F.array_distinct(names))


def block_reason(labels: Column) -> Column:
    return F.when(F.size(labels) > 0, F.array_join(labels, ", "))


def pii_audit(df: DataFrame, policy: Policy) -> DataFrame:
    """Per label and action: spans, texts touched and mean score.

    Each text is first reduced to one row per label, so texts are counted without a distinct
    and only a handful of partial rows per task are shuffled.
    """
    per_text = (
        flatten(df, F.array_distinct(F.transform("entities", lambda e: e["label"])), "label", "entities")
        .select("label", F.filter("entities", lambda e: e["label"] == F.col("label")).alias("own"))
        .select(
            "label",
            policy.action(F.col("label")).alias("action"),
            F.size("own").cast("long").alias("n"),
            F.aggregate("own", F.lit(0.0), lambda acc, e: acc + e["score"]).alias("score_sum"),
        )
    )
    return per_text.groupBy("label", "action").agg(
        F.sum("n").alias("spans"),
        F.count(F.lit(1)).alias("texts"),
        (F.sum("score_sum") / F.sum("n")).alias("mean_score"),
    )


_PLUGINS: dict[str, Callable] = {}


def register_detector(name: str, fn: Callable[[Iterator], Iterator]) -> None:
    """Register a detector of one's own.

    ``fn`` takes an iterator of pandas frames (id, text) and yields frames (id, entities); a
    model loaded before its loop is loaded once per task.
    """
    _PLUGINS[name] = fn


def plugin_entities(df: DataFrame, id_col: str, text: str, name: str) -> DataFrame:
    fn = _PLUGINS[name]
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, entities {ENTITIES.simpleString()}"
    return df.select(id_col, text).mapInPandas(fn, schema)


def plugin_detected(
    df: DataFrame, id_col: str, text: str, name: str, threshold: float = pii.DEFAULT_THRESHOLD,
    policy: Policy | None = None, custom: list[str] = (),
) -> DataFrame:
    """``df`` with the spans of a registered detector as ``entities``, treated like catalogue spans.

    Weak spans go, labels get their canonical names, labels without an action go, overlaps are resolved. Ids must be
    unique; a text that the detector says nothing about has no spans.
    """
    policy = Policy() if policy is None else policy
    found = plugin_entities(df, id_col, text, name).withColumnRenamed("entities", "_found")
    admitted = "true"
    if policy.default_action is None:
        admitted = "e.label IN (" + ", ".join(sql_literal(x) for x in policy.actions) + ")" if policy.actions else "false"
    named = (
        f"transform(filter(_found, e -> e.score >= {threshold}D), e -> named_struct('label', {canonical_sql('e.label', custom)}, "
        "'start', e.start, 'end', e.end, 'score', e.score, 'value', e.value))"
    )
    spans = resolve_sql(f"filter({named}, e -> {admitted})")
    return df.join(found, id_col, "left").withColumn("entities", F.expr(f"CASE WHEN _found IS NULL THEN {NO_ENTITIES} ELSE {spans} END")).drop("_found")
