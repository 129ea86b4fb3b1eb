"""Queries that score two detection profiles on injected samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import pii
from ..operators import evaluate as e
from ..operators.detect import Detector
from ..session import materialise, read_table
from . import sqltext as q
from .factory import CODE_PATTERN, SAMPLES_SQL, samples

# Two profiles: the second knows employee codes and takes long digit runs for accounts,
# but misses e-mail addresses, and it reads numbers with dashes as phone numbers only.
PROFILES = {
    "base": [("email address", pii.PATTERNS["email address"], 0.9), ("SSN", pii.PATTERNS["social security number"], 0.8),
             ("person", pii.PATTERNS["person"], 0.6)],
    "tuned": [("PHONE", r"[0-9]{3}-[0-9]{2,3}-[0-9]{4}", 0.9), ("employee code", CODE_PATTERN, 0.95),
              ("email address", r"[a-z0-9]+@mail", 0.7), ("FIRSTNAME", r"[A-Z][a-z]{9,}", 0.5), ("password", pii.PATTERNS["password"], 0.2)],
}
CANONICAL = {"SSN": "social security number", "PHONE": "phone number", "FIRSTNAME": "person"}


def profiles() -> dict[str, list[Detector]]:
    return {run: [Detector(*d) for d in found] for run, found in PROFILES.items()}


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return e.paired(e.eval_set(samples(spark, sf)), profiles())


def matches(spark, sf) -> DataFrame:
    """One pass of matching, stored for the reports that share it."""
    return materialise(e.match_spans(pairs(spark, sf)), "matches")


def span_matches(spark, sf):
    out = e.match_spans(pairs(spark, sf))
    return out.select(
        "run_id", "sample_id", F.size("truth").cast("long").alias("n_truth"), F.size("pred").cast("long").alias("n_pred"),
        F.size("matched").cast("long").alias("n_matched"), F.size("false_positives").cast("long").alias("n_fp"), F.size("false_negatives").cast("long").alias("n_fn"),
        F.round(F.aggregate("matched", F.lit(0.0), lambda a, m: a + m["iou"]), 6).alias("iou_sum"),
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def entity_metrics(spark, sf):
    return _rounded(e.entity_metrics(e.match_spans(pairs(spark, sf))), "precision", "recall", "f1")


_SUMMARY = [f"{kind}_{rate}" for kind in ("micro", "macro") for rate in ("precision", "recall", "f1")]


def summary_metrics(spark, sf):
    return _rounded(e.summary_metrics(e.entity_metrics(e.match_spans(pairs(spark, sf)))), *_SUMMARY)


def char_accuracy(spark, sf):
    return _rounded(e.char_accuracy(pairs(spark, sf)), "accuracy")


def confusion(spark, sf):
    return e.confusion(matches(spark, sf))


def error_analysis(spark, sf):
    rows = e.error_analysis(matches(spark, sf), "base", "tuned")
    return rows.select("kind", "sample_id", "pos", "domain", F.col("entity.label").alias("label"), F.col("entity.start").alias("start"))


def error_analysis_all(spark, sf):
    rows = e.error_analysis(matches(spark, sf), "base", "tuned", None)
    return rows.select("kind", "sample_id", "pos", F.col("entity.label").alias("label"), F.col("entity.start").alias("start"))


def run_comparison(spark, sf):
    out = e.compare_runs(e.entity_metrics(matches(spark, sf)), "base", "tuned")
    return _rounded(out, *[c for c in out.columns if c not in ("label", "change")])


def summary_differences(spark, sf):
    """What the second run gains over the first in each rate and in character accuracy."""
    stored = matches(spark, sf)
    rates = e.summary_metrics(e.entity_metrics(stored)).join(e.char_accuracy(pairs(spark, sf)).select("run_id", "accuracy"), "run_id")
    out = e.compare_summaries(rates, "base", "tuned", [*_SUMMARY, "accuracy"])
    return _rounded(out, *out.columns)


def leaderboard(spark, sf):
    """Runs are registered per supplier nation name; two of them have been evaluated."""
    summaries = e.summary_metrics(e.entity_metrics(matches(spark, sf)))
    nations = read_table(spark, sf, "nation").select(
        F.when(F.col("n_nationkey") == 3, "base").when(F.col("n_nationkey") == 5, "tuned").otherwise(F.lower("n_name")).alias("run_id"),
        F.col("n_nationkey").alias("created_at"),
    )
    return _rounded(e.leaderboard(nations, summaries, "tuned"), "macro_precision", "macro_recall", "macro_f1")


QUERIES = {
    fn.__name__: fn
    for fn in (
        span_matches, entity_metrics, summary_metrics, char_accuracy, confusion, error_analysis, error_analysis_all,
        run_comparison, summary_differences, leaderboard,
    )
}


def _predictions() -> str:
    parts = []
    for run, found in PROFILES.items():
        for i, (label, pattern, score) in enumerate(found):
            if score < pii.DEFAULT_THRESHOLD:
                continue
            text, pat = q.asciified("text"), q.asciified_pattern(pattern)
            parts.append(
                f"""SELECT '{run}' AS run_id, sample_id, {q.quote(CANONICAL.get(label, label))} AS label, {score} AS score, {i} AS ord,
                  CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:k-1], lambda x: length(x))), 0) AS INTEGER) AS "start",
                  CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + list_sum(list_transform(v[1:k], lambda x: length(x))) AS INTEGER) AS "end"
                FROM (SELECT sample_id, v, g, unnest(range(1, len(v) + 1)) AS k FROM (SELECT sample_id, regexp_extract_all({text}, {pat}) AS v, string_split_regex({text}, {pat}) AS g FROM tested) WHERE len(v) > 0)"""
            )
    return " UNION ALL ".join(parts)


# Spans do not overlap inside one side, and no pair sits at exactly one half: matches are unique.
_BASE = f"""WITH {SAMPLES_SQL}, truth AS (SELECT sample_id, i, label, "start", "end" FROM entities),
  tested AS (SELECT * FROM samples WHERE sample_id IN (SELECT sample_id FROM truth)),
  raw AS ({_predictions()}),
  pred AS MATERIALIZED (SELECT run_id, sample_id, row_number() OVER (PARTITION BY run_id, sample_id ORDER BY u.n."start") AS p, u.n.label AS label, u.n."start" AS "start", u.n."end" AS "end"
    FROM (SELECT run_id, sample_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x:
        CASE WHEN x[1]."start" >= acc[-1]."end" THEN acc || x WHEN x[1]."end" - x[1]."start" > acc[-1]."end" - acc[-1]."start" THEN acc[:-2] || x ELSE acc END)) AS n
      FROM (SELECT run_id, sample_id, list({{'label': label, 'start': "start", 'end': "end"}} ORDER BY "start", ord) AS l FROM raw GROUP BY ALL)) u),
  runs(run_id) AS (VALUES ('base'), ('tuned')),
  iou AS MATERIALIZED (SELECT run_id, p.sample_id, p.p, t.i, p.label AS pl, t.label AS tl,
      greatest(0, least(p."end", t."end") - greatest(p."start", t."start")) / (greatest(p."end", t."end") - least(p."start", t."start")) AS iou
    FROM pred p JOIN truth t ON p.sample_id = t.sample_id AND p."start" < t."end" AND t."start" < p."end"),
  hit AS (SELECT * FROM iou WHERE iou >= 0.5),
  fp AS (SELECT * FROM pred p WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.run_id = p.run_id AND h.sample_id = p.sample_id AND h.p = p.p)),
  fn AS (SELECT r.run_id, t.* FROM runs r, truth t WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.run_id = r.run_id AND h.sample_id = t.sample_id AND h.i = t.i)),
  c AS (SELECT run_id, pl AS label, 1 AS tp, 0 AS fp, 0 AS fn, 1 AS support FROM hit WHERE pl = tl
    UNION ALL SELECT run_id, pl, 0, 1, 0, 0 FROM hit WHERE pl <> tl UNION ALL SELECT run_id, tl, 0, 0, 1, 1 FROM hit WHERE pl <> tl
    UNION ALL SELECT run_id, label, 0, 1, 0, 0 FROM fp UNION ALL SELECT run_id, label, 0, 0, 1, 1 FROM fn),
  n AS (SELECT run_id, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(support) AS BIGINT) AS support FROM c GROUP BY ALL),
  r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM n),
  m AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r),
  s AS (SELECT run_id, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
    coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0) AS mp, coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0) AS mr FROM m GROUP BY run_id)"""
_ERRORS = """fixed AS (SELECT 'fixed_miss' AS kind, f.sample_id, f.i AS o, f.label, f."start" FROM fn f WHERE f.run_id = 'base'
    AND EXISTS (SELECT 1 FROM iou h WHERE h.run_id = 'tuned' AND h.sample_id = f.sample_id AND h.i = f.i AND h.iou >= 0.5)),
  broken AS (SELECT 'new_false_positive' AS kind, f.sample_id, f.p AS o, f.label, f."start" FROM fp f WHERE f.run_id = 'tuned'
    AND NOT EXISTS (SELECT 1 FROM pred b WHERE b.run_id = 'base' AND b.sample_id = f.sample_id
      AND greatest(0, least(b."end", f."end") - greatest(b."start", f."start")) / (greatest(b."end", f."end") - least(b."start", f."start")) >= 0.5)),
  listed AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind, sample_id ORDER BY o) - 1 AS INTEGER) AS pos FROM (SELECT * FROM fixed UNION ALL SELECT * FROM broken))"""

_CHARS = f"""t AS (SELECT sample_id, label, unnest(range("start", "end")) AS c FROM truth), p AS (SELECT run_id, sample_id, label, unnest(range("start", "end")) AS c FROM pred),
        tt AS (SELECT run_id, t.* FROM runs, t),
        bad AS (SELECT coalesce(tt.run_id, p.run_id) AS run_id, count(*) FILTER (tt.label IS DISTINCT FROM p.label) AS n FROM tt FULL JOIN p ON tt.run_id = p.run_id AND tt.sample_id = p.sample_id AND tt.c = p.c GROUP BY 1),
        total AS (SELECT CAST(sum(length(text)) AS BIGINT) AS chars FROM tested)"""

ORACLES = {
    "span_matches": f"""{_BASE} SELECT run_id, sample_id, (SELECT count(*) FROM truth t WHERE t.sample_id = x.sample_id) AS n_truth,
        (SELECT count(*) FROM pred p WHERE p.sample_id = x.sample_id AND p.run_id = x.run_id) AS n_pred,
        (SELECT count(*) FROM hit p WHERE p.sample_id = x.sample_id AND p.run_id = x.run_id) AS n_matched,
        (SELECT count(*) FROM fp p WHERE p.sample_id = x.sample_id AND p.run_id = x.run_id) AS n_fp,
        (SELECT count(*) FROM fn p WHERE p.sample_id = x.sample_id AND p.run_id = x.run_id) AS n_fn,
        round(coalesce((SELECT sum(iou) FROM hit p WHERE p.sample_id = x.sample_id AND p.run_id = x.run_id), 0), 6) AS iou_sum
        FROM (SELECT run_id, sample_id FROM runs, tested) x""",
    "entity_metrics": f"{_BASE} SELECT run_id, label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m",
    "summary_metrics": f"""{_BASE} SELECT run_id, round(mp, 6) AS micro_precision, round(mr, 6) AS micro_recall, round(CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0 END, 6) AS micro_f1,
        round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1 FROM s""",
    "char_accuracy": f"""{_BASE}, {_CHARS}
        SELECT run_id, chars, chars - n AS equal, round((chars - n) / chars, 6) AS accuracy FROM bad, total""",
    "summary_differences": f"""{_BASE}, {_CHARS}, v AS (SELECT run_id, mp AS micro_precision, mr AS micro_recall, CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0 END AS micro_f1,
          macro_precision, macro_recall, macro_f1, (chars - n) / chars AS accuracy FROM s JOIN bad USING (run_id), total)
        SELECT {', '.join(f"round(max({c}) FILTER (run_id = 'tuned') - max({c}) FILTER (run_id = 'base'), 6) AS {c}_delta" for c in [*_SUMMARY, 'accuracy'])} FROM v""",
    "confusion": f"""{_BASE}, axis AS (SELECT DISTINCT label FROM (SELECT label FROM truth UNION ALL SELECT label FROM pred))
        SELECT r.run_id, a.label AS gt_label, b.label AS pred_label, (SELECT count(*) FROM hit h WHERE h.run_id = r.run_id AND h.tl = a.label AND h.pl = b.label) AS n FROM runs r, axis a, axis b""",
    "error_analysis": f"""{_BASE}, {_ERRORS}, top AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sample_id, pos) AS rn FROM listed)
        SELECT kind, sample_id, pos, domain, label, "start" FROM top JOIN samples USING (sample_id) WHERE rn <= {e.EXAMPLES}""",
    "error_analysis_all": f"""{_BASE}, {_ERRORS} SELECT kind, sample_id, pos, label, "start" FROM listed""",
    "run_comparison": f"""{_BASE}, b AS (SELECT * FROM m WHERE run_id = 'base'), t AS (SELECT * FROM m WHERE run_id = 'tuned')
        SELECT label, round(coalesce(b.precision, 0), 6) AS base_precision, round(coalesce(b.recall, 0), 6) AS base_recall, round(coalesce(b.f1, 0), 6) AS base_f1, coalesce(b.support, 0) AS base_support,
          round(coalesce(t.precision, 0), 6) AS new_precision, round(coalesce(t.recall, 0), 6) AS new_recall, round(coalesce(t.f1, 0), 6) AS new_f1, coalesce(t.support, 0) AS new_support,
          round(coalesce(t.f1, 0) - coalesce(b.f1, 0), 6) AS f1_delta,
          CASE WHEN coalesce(t.f1, 0) > coalesce(b.f1, 0) THEN 'better' WHEN coalesce(t.f1, 0) < coalesce(b.f1, 0) THEN 'worse' ELSE 'same' END AS change
        FROM b FULL JOIN t USING (label)""",
    "leaderboard": f"""{_BASE}, runs2 AS (SELECT CASE n_nationkey WHEN 3 THEN 'base' WHEN 5 THEN 'tuned' ELSE lower(n_name) END AS run_id, n_nationkey AS created_at FROM nation)
        SELECT run_id, created_at, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1,
          CASE WHEN run_id = 'tuned' THEN 'active' ELSE 'inactive' END AS status FROM runs2 LEFT JOIN s USING (run_id)""",
}
