"""Queries that build and check labelled text from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import factory as f
from ..catalog import pii
from ..functions.regex import full_pattern
from ..functions.scale import numbered
from ..operators import inject as inj
from ..operators import leakage as leak
from ..operators import minhash
from ..operators import evaluate, neardup, quality, slots, tagging, training, values
from ..operators.detect import exploded
from ..session import fresh_path, materialise, read_table, read_texts, small_table
from ..sources import generated
from ..sources import samples as files
from . import sqltext as q

PLAN_LABELS = ["person", "email address", "social security number", "phone number", "api key"]
EMAIL = pii.PATTERNS["email address"]

# Labels of the carrier sentences, by message number; the last two are a label of our own and no label.
CARRIER_LABELS = ["email address", "social security number", "phone number", "employee code", f.NEUTRAL_LABEL]
CODE_PATTERN = r"EC-[0-9]{4}"
CONFIGS = [(x, pii.PATTERNS.get(x, CODE_PATTERN)) for x in CARRIER_LABELS[:-1]]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_texts(spark, sf, "documents", "doc_id")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return read_texts(spark, sf, "conversations", "conv_id", "turn")


# -- plans ---------------------------------------------------------------------------------


def document_slots(spark, sf) -> DataFrame:
    """One slot per document, numbered from 0 in order of their ids."""
    docs = read_table(spark, sf, "documents").select("doc_id")
    rows = numbered(docs, [], ["doc_id"], "slot").select((F.col("slot") - 1).alias("slot"))
    return slots.assign_slots(rows, "slot", docs.count(), slots.label_configs(PLAN_LABELS))


def slot_plan(spark, sf):
    return document_slots(spark, sf).select("slot", "part", "label", "is_hard_negative")


def batch_plan(spark, sf):
    return slots.plan_batches(document_slots(spark, sf)).select(
        "label", "is_hard_negative", "batch", "count", "first_slot"
    )


def topup_plan(spark, sf):
    """As many samples as documents were asked for; those with a quality label of one were made."""
    asked = read_table(spark, sf, "documents")
    made = read_table(spark, sf, "labels").filter("quality = 1")
    return slots.plan_topup(asked, made, slots.label_configs(PLAN_LABELS)).select("batch", "label", "count")


def value_synthesis(spark, sf):
    """A drawn value per document slot: it matches its label's pattern unless it is a hard negative."""
    configs = slots.label_configs(PLAN_LABELS)
    rows = document_slots(spark, sf).filter(F.col("label") != f.NEUTRAL_LABEL)
    made = values.synthesize_values(rows, configs, seed=7).withColumn("value", F.element_at("values", 1))
    fits = None
    for label, pattern in configs:
        hit = F.col("value").rlike(full_pattern(pattern))
        fits = F.when(F.col("label") == label, hit) if fits is None else fits.when(F.col("label") == label, hit)
    return made.select("slot", "label", "is_hard_negative", fits.alias("matches"), (F.trim("value") != "").alias("filled"))


# -- samples -------------------------------------------------------------------------------


def _number(mult: int, low: int, size: int):
    """A number from message and place, the same in both dialects."""
    return lambda key, i: ((key * mult + i.cast("long") * 7919) % size + low).cast("string")


def carriers(spark, sf) -> DataFrame:
    """Messages as carrier sentences: a place to fill before every line end, none in one-line messages."""
    rows = messages(spark, sf)
    key = F.col("conv_id") * 16 + F.col("turn")
    sentence = F.replace("text", F.lit(".\n"), F.lit(" [PII].\n"))
    labels = F.array(*[F.lit(x) for x in CARRIER_LABELS])
    pool = F.array(*[F.lit(x) for x in f.TRAINING_DOMAINS])
    rows = rows.select(
        key.alias("sample_id"),
        sentence.alias("sentence"),
        F.element_at(labels, (key % len(CARRIER_LABELS) + 1).cast("int")).alias("label"),
        F.element_at(pool, (F.col("conv_id") % len(f.TRAINING_DOMAINS) + 1).cast("int")).alias("domain"),
    ).withColumn("is_hard_negative", (F.col("label") != f.NEUTRAL_LABEL) & (F.col("sample_id") % 8 == 3))
    a, b, c = _number(31, 100, 900), _number(17, 10, 90), _number(13, 1000, 9000)
    sid = F.col("sample_id")

    def made(i):
        mail = F.concat(F.lit("user"), c(sid, i), F.lit("@mail.example.com"))
        ssn = F.concat(a(sid, i), F.lit("-"), b(sid, i), F.lit("-"), c(sid, i))
        phone = F.concat(a(sid, i), F.lit("-"), a(sid + 1, i), F.lit("-"), c(sid, i))
        code = F.concat(F.lit("EC-"), c(sid, i))
        by_label = (
            F.when(F.col("label") == CARRIER_LABELS[0], mail).when(F.col("label") == CARRIER_LABELS[1], ssn)
            .when(F.col("label") == CARRIER_LABELS[2], phone).otherwise(code)
        )
        return F.when(F.col("is_hard_negative"), F.concat(F.lit("x"), F.substring(by_label, 2, 100))).otherwise(by_label)

    filled = inj.placeholders(F.col("sentence"))
    places = F.when(F.col("is_hard_negative"), filled + 1).otherwise(F.greatest(filled, F.lit(1)))
    return rows.withColumn("values", F.transform(F.sequence(F.lit(1), places), made))


def samples(spark, sf) -> DataFrame:
    return inj.as_samples(inj.inject(carriers(spark, sf)), "sample_id")


def stored_samples(spark, sf) -> DataFrame:
    """The samples as a data set of their own, for jobs that read them more than once."""
    return materialise(samples(spark, sf), "samples")


def injected_samples(spark, sf):
    rows = samples(spark, sf)
    spans = F.transform("entities", lambda e: F.concat_ws(":", e["label"], e["start"].cast("string"), e["end"].cast("string"), e["value"]))
    return rows.select("sample_id", "text", "domain", "is_hard_negative", F.array_join(spans, "|").alias("spans"))


def _spoiled(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Samples written as JSON lines and read back, some of them broken in between."""
    path, broken = fresh_path(spark, "sample-lines"), fresh_path(spark, "spoiled-lines")
    files.write_samples(samples(spark, sf), path)
    line, number = F.col("value"), F.regexp_extract("value", r'"sample_id":(-?[0-9]+)', 1).cast("long")
    spoiled = F.when(number % 11 == 2, F.substring(line, F.lit(1), F.length(line) - 3)).when(
        number % 11 == 5, F.regexp_replace(line, '"text":', '"words":')
    )
    spark.read.text(path).select(F.coalesce(spoiled, line).alias("value")).write.text(broken)
    return files.read_samples(spark, broken, lines=True)


def samples_read_back(spark, sf):
    good, _ = _spoiled(spark, sf)
    return good.select("sample_id", "text", "domain", "is_hard_negative", F.size("entities").cast("long").alias("spans"))


def samples_quarantined(spark, sf):
    _, held = _spoiled(spark, sf)
    return held.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def cross_labelled(spark, sf):
    """The same with every other catalogue pattern scanned in; the own label wins overlaps."""
    rows = inj.inject(carriers(spark, sf), cross_label=True)
    return exploded(rows, "sample_id").drop("score")


def damaged(spark, sf) -> DataFrame:
    """Samples of which some have a shifted span or a value that breaks its pattern."""
    rows = samples(spark, sf)
    shifted = F.transform("entities", lambda e: e.withField("start", e["start"] + 1))
    misnamed = F.transform("entities", lambda e: e.withField("label", F.lit("employee code")))
    return rows.withColumn(
        "entities",
        F.when(F.col("sample_id") % 9 == 4, shifted).when(F.col("sample_id") % 9 == 7, misnamed).otherwise(F.col("entities")),
    )


def sample_validation(spark, sf):
    return quality.checked(damaged(spark, sf), CONFIGS).select("sample_id", "reject_reason")


def validation_report(spark, sf):
    rows = quality.checked(damaged(spark, sf), CONFIGS)
    report = quality.generation_report(rows, 400, 7)
    return report.withColumns({c: F.round(c, 6) for c in ("percent_hard_negatives", "near_dup_rate")})


def sample_domains(spark, sf):
    return quality.domain_distribution(samples(spark, sf)).withColumn("percent", F.round("percent", 6))


def sample_labels(spark, sf):
    return quality.label_distribution(samples(spark, sf)).withColumn("percent", F.round("percent", 6))


def sample_balance(spark, sf):
    return quality.balance(samples(spark, sf)).withColumn("percent_of_samples", F.round("percent_of_samples", 6))


# -- generator output ----------------------------------------------------------------------


def raw_outputs(spark, sf) -> DataFrame:
    """Messages dressed up as raw generator output in every form that is read."""
    rows = messages(spark, sf)
    key = F.col("conv_id") * 16 + F.col("turn")
    lines = F.split("text", "\n", -1)
    array = F.to_json(lines)
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    quoted = F.array_join(F.transform(lines, lambda x: F.concat(F.lit('  "'), x, F.lit('"'))), "\n")
    form = F.col("conv_id") % 6
    raw = (
        F.when(form == 0, array)
        .when(form == 1, F.concat(F.lit("Here you are:\n"), array, F.lit("\nAnything else?")))
        .when(form == 2, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
        .when(form == 3, numbered)
        .when(form == 4, F.concat(F.lit("```\n"), quoted, F.lit("\n```")))
        .otherwise(F.concat(F.lit("[\n"), quoted, F.lit("\n]")))
    )
    return rows.select(key.alias("batch_id"), form.alias("form"), raw.alias("raw"))


def harvested_sentences(spark, sf):
    return generated.harvest_generations(raw_outputs(spark, sf))


def accepted_batches(spark, sf) -> DataFrame:
    rows = raw_outputs(spark, sf).withColumn("sentences", generated.harvested(F.col("raw")))
    return neardup.drop_near_duplicates(rows, threshold=0.5)


def near_duplicates(spark, sf):
    """Sentences kept and dropped per generated batch."""
    return accepted_batches(spark, sf).select("batch_id", F.size("sentences").alias("count"), F.size("accepted").alias("samples"), "near_dups")


def factory_progress(spark, sf):
    rows = near_duplicates(spark, sf)
    return slots.progress(rows).select("batch_id", "total_attempts", "successful", "near_dup_count")


def tagged_ingest(spark, sf):
    """Documents with their e-mail addresses marked up, read back as text and spans."""
    marked = documents(spark, sf).select(
        "doc_id", F.regexp_replace("text", EMAIL, "<Email Address>$0</Email Address>").alias("tagged")
    )
    return exploded(generated.ingest_tagged(marked, "tagged"), "doc_id").drop("score")


def tagged_text(spark, sf):
    marked = documents(spark, sf).select(
        "doc_id", F.regexp_replace("text", EMAIL, "<Email Address>$0</Email Address>").alias("tagged")
    )
    return generated.ingest_tagged(marked, "tagged").select("doc_id", "text")


def leakage(spark, sf):
    """Labelled documents, as the test set, that another document gives away."""
    test, train = _labelled_and_other(spark, sf)
    return leak.leakage(test, train, "doc_id", "doc_id").withColumn("overlap", F.round("overlap", 6))


def _labelled_and_other(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs, labelled = documents(spark, sf), read_table(spark, sf, "labels").select("doc_id")
    return docs.join(labelled, "doc_id", "left_semi"), docs.join(labelled, "doc_id", "left_anti")


def leakage_likely(spark, sf):
    """Recall of the banded search against the exact join, per language of the test text."""
    test, train = _labelled_and_other(spark, sf)
    sets = leak.token_sets(test, "doc_id"), leak.token_sets(train, "doc_id")
    exact = leak.leakage(test, train, "doc_id", "doc_id", sets=sets)
    likely = minhash.likely_leakage(test, train, "doc_id", "doc_id", sets=sets)
    return minhash.recall(exact, likely, test, "doc_id", "lang").select("lang", "leaked", (F.col("recall") >= 0.9).alias("recalled"))


def leakage_benchmark(spark, sf):
    """Benchmark items against all documents, at a low threshold: passages inside longer texts."""
    return leak.leakage(
        read_table(spark, sf, "benchmark"), documents(spark, sf), "item_id", "doc_id", threshold=0.1
    ).withColumn("overlap", F.round("overlap", 6))


# -- training data -------------------------------------------------------------------------

BASE_TAGS = ["O", "B-FIRSTNAME", "I-FIRSTNAME", "B-EMAIL", "I-EMAIL", "B-LASTNAME", "I-LASTNAME", "B-SSN", "B-EMPLOYEE_CODE"]


def base_vocab(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(enumerate(BASE_TAGS)), "id int, tag string")


def stored_vocab(rows: DataFrame) -> DataFrame:
    """The grown vocabulary, written once: jobs look into it several times."""
    return materialise(tagging.grow_vocab(rows, base_vocab(rows.sparkSession)), "vocab")


def vocab_growth(spark, sf):
    return tagging.grow_vocab(samples(spark, sf), base_vocab(spark))


def vocab_labels(spark, sf):
    grown = tagging.grow_vocab(samples(spark, sf), base_vocab(spark))
    far = grown.withColumn("id", F.when(F.col("id") >= len(BASE_TAGS), F.col("id") + 102).otherwise(F.col("id")))
    return tagging.vocab_labels(far, ["membership card"])


def bio_tags(spark, sf):
    rows = stored_samples(spark, sf)
    return tagging.bio_tag(rows, stored_vocab(rows)).select(
        "sample_id", "pos", "start", "end", "token", "tag_id"
    )


def class_weights(spark, sf):
    rows = stored_samples(spark, sf)
    vocab = stored_vocab(rows)
    return tagging.class_weights(tagging.bio_tag(rows, vocab), vocab).withColumn("weight", F.round("weight", 6))


def tagger_metrics(spark, sf):
    """A tagger trained on the samples and scored as a detector on those with entities."""
    rows = stored_samples(spark, sf)
    custom = ["EMPLOYEE_CODE"]
    vocab = stored_vocab(rows)
    weights = tagging.class_weights(tagging.bio_tag(rows, vocab), vocab)
    train = materialise(training.training_rows(rows, vocab, weights), "train")
    model = training.train_tagger(train, max_iter=10)
    found = training.tagger_detect(evaluate.eval_set(rows), model, vocab, custom=custom)
    pairs = found.select(
        F.lit("tagger").alias("run_id"), "sample_id", "text", "domain",
        evaluate.canonical_spans("entities", custom).alias("truth"), "pred",
    )
    return evaluate.entity_metrics(evaluate.match_spans(pairs))


def curve_summary(spark, sf):
    """Events read as a training log: one run per user."""
    log = read_table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("loss"),
        F.when(F.col("event_id") % 3 > 0, F.col("value") / 1e6).alias("learning_rate"),
    )
    out = tagging.curve_summary(log)
    return out.withColumns({c: F.round(c, 6) for c in ("reduction_percent", "last_learning_rate")})


QUERIES = {
    fn.__name__: fn
    for fn in (
        slot_plan, batch_plan, topup_plan, value_synthesis, injected_samples, samples_read_back, samples_quarantined, cross_labelled, sample_validation,
        validation_report, sample_domains, sample_labels, sample_balance, harvested_sentences, near_duplicates,
        factory_progress, tagged_ingest, tagged_text, leakage, leakage_likely, leakage_benchmark, vocab_growth, vocab_labels, bio_tags,
        class_weights, tagger_metrics, curve_summary,
    )
}

_L = len(PLAN_LABELS)
_PLAN_LIST = "[" + ", ".join(q.quote(x) for x in PLAN_LABELS) + "]"
_SLOTS = f"""size AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * {f.NEUTRAL_SHARE}) AS BIGINT)) AS neutral FROM documents),
  quota AS (SELECT n - neutral AS rest, (n - neutral) // {_L} AS share, CAST(floor(((n - neutral) // {_L}) * {f.HARD_NEGATIVE_SHARE}) AS BIGINT) AS neg FROM size),
  numbered AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id FROM documents),
  slots AS (SELECT doc_id AS slot, CASE WHEN doc_id < share * {_L} THEN 'quota' WHEN doc_id < rest THEN 'remainder' ELSE 'neutral' END AS part,
    CASE WHEN doc_id < share * {_L} THEN {_PLAN_LIST}[doc_id // share + 1] WHEN doc_id < rest THEN {_PLAN_LIST}[(doc_id - share * {_L}) % {_L} + 1] ELSE 'NEUTRAL' END AS label,
    doc_id < share * {_L} AND doc_id % share >= share - neg AS is_hard_negative FROM numbered, quota)"""

_C_LIST = "[" + ", ".join(q.quote(x) for x in CARRIER_LABELS) + "]"
_D_LIST = "[" + ", ".join(q.quote(x) for x in f.TRAINING_DOMAINS) + "]"


def _n(mult, low, size, key="sample_id"):
    return f"CAST(({key} * {mult} + i * 7919) % {size} + {low} AS VARCHAR)"


_VALUE = f"""CASE label WHEN 'email address' THEN 'user' || {_n(13, 1000, 9000)} || '@mail.example.com'
    WHEN 'social security number' THEN {_n(31, 100, 900)} || '-' || {_n(17, 10, 90)} || '-' || {_n(13, 1000, 9000)}
    WHEN 'phone number' THEN {_n(31, 100, 900)} || '-' || {_n(31, 100, 900, '(sample_id + 1)')} || '-' || {_n(13, 1000, 9000)}
    ELSE 'EC-' || {_n(13, 1000, 9000)} END"""
SAMPLES_SQL = f"""carriers AS (SELECT *, label <> 'NEUTRAL' AND sample_id % 8 = 3 AS is_hard_negative FROM (
      SELECT conv_id * 16 + turn AS sample_id, replace(text, '.' || chr(10), ' [PII].' || chr(10)) AS sentence,
        {_C_LIST}[(conv_id * 16 + turn) % {len(CARRIER_LABELS)} + 1] AS label, {_D_LIST}[conv_id % {len(f.TRAINING_DOMAINS)} + 1] AS domain FROM conversations)),
  gaps AS (SELECT * EXCLUDE (g), CASE WHEN is_hard_negative AND contains(sentence, '[PII]')
      THEN g[1:len(g) - 1] || [g[-1] || CASE WHEN ends_with(g[-1], ' ') THEN '' ELSE ' ' END, ''] ELSE g END AS g FROM (
    SELECT *, CASE WHEN contains(sentence, '[PII]') THEN string_split(sentence, '[PII]')
      ELSE [CASE WHEN sentence = '' OR ends_with(sentence, ' ') THEN sentence ELSE sentence || ' ' END, ''] END AS g FROM carriers)),
  places AS (SELECT *, unnest(range(1, len(g))) AS i FROM gaps WHERE label <> 'NEUTRAL'),
  valued AS (SELECT * EXCLUDE (v), CASE WHEN is_hard_negative THEN 'x' || substring(v, 2) ELSE v END AS v FROM (SELECT *, {_VALUE} AS v FROM places)),
  filled AS (SELECT *, sum(length(g[i])) OVER w + coalesce(sum(length(v)) OVER (PARTITION BY sample_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
    FROM valued WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
  entities AS MATERIALIZED (SELECT sample_id, i, lower(label) AS label, CAST(s AS INTEGER) AS "start", CAST(s + length(v) AS INTEGER) AS "end", v AS value FROM filled WHERE NOT is_hard_negative),
  samples AS MATERIALIZED (SELECT c.sample_id, coalesce(t.text, sentence) AS text, domain, c.is_hard_negative FROM carriers c LEFT JOIN (
    SELECT sample_id, string_agg(g[i] || v, '' ORDER BY i) || any_value(g[-1]) AS text FROM filled GROUP BY sample_id) t USING (sample_id))"""

_CHECKED = f"""faults AS (SELECT e.sample_id, e.i, CASE WHEN e.sample_id % 9 = 4 THEN 'offset'
      WHEN NOT regexp_full_match(value, CASE CASE WHEN e.sample_id % 9 = 7 THEN 'employee code' ELSE label END {' '.join(f"WHEN {q.quote(a)} THEN {q.quote(b)}" for a, b in CONFIGS)} END) THEN 'pattern' END AS fault FROM entities e),
  checked AS (SELECT s.*, f.reject_reason FROM samples s LEFT JOIN (SELECT sample_id, arg_min(fault, i) AS reject_reason FROM faults WHERE fault IS NOT NULL GROUP BY sample_id) f USING (sample_id))"""

_RAW_LINES = """SELECT conv_id * 16 + turn AS batch_id, conv_id % 6 AS form, string_split(text, chr(10)) AS l FROM conversations"""
_VOCAB = "base(id, tag) AS (VALUES " + ", ".join(f"({i}, {q.quote(t)})" for i, t in enumerate(BASE_TAGS)) + ")"
_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Ids of the labels present: e-mail addresses are known, the others are appended in order.
_GROWN = f"""{_VOCAB}, present AS (SELECT DISTINCT label FROM entities),
  lacking AS (SELECT label, replace(upper(label), ' ', '_') AS suffix FROM present WHERE label <> 'email address'),
  fresh AS (SELECT label, k, tag FROM (SELECT label, 0 AS k, 'B-' || suffix AS tag FROM lacking UNION ALL SELECT label, 1, 'I-' || suffix FROM lacking) WHERE tag NOT IN (SELECT tag FROM base)),
  vocab AS (SELECT id, tag FROM base UNION ALL SELECT CAST({len(BASE_TAGS)} + row_number() OVER (ORDER BY label, k) - 1 AS INTEGER), tag FROM fresh),
  ids AS (SELECT label, CASE WHEN label = 'email address' THEN 3 ELSE (SELECT min(id) FROM vocab v WHERE v.tag = 'B-' || replace(upper(p.label), ' ', '_')) END AS b,
     CASE WHEN label = 'email address' THEN 4 ELSE (SELECT min(id) FROM vocab v WHERE v.tag = 'I-' || replace(upper(p.label), ' ', '_')) END AS i FROM present p)"""
_BIO = f"""parts AS (SELECT sample_id, regexp_extract_all(text, '{_TOKENS}') AS v, string_split_regex(text, '{_TOKENS}') AS g FROM samples),
  numbered AS (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM parts WHERE len(v) > 0),
  tokens AS (SELECT sample_id, k - 1 AS pos, v[k] AS token, sum(length(g[k])) OVER w + coalesce(sum(length(v[k])) OVER (PARTITION BY sample_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
    FROM numbered WINDOW w AS (PARTITION BY sample_id ORDER BY k)),
  bio AS MATERIALIZED (SELECT t.sample_id, CAST(pos AS INTEGER) AS pos, CAST(s AS INTEGER) AS "start", CAST(s + length(token) AS INTEGER) AS "end", token,
      CAST(coalesce(CASE WHEN s = e."start" THEN b ELSE ids.i END, 0) AS INTEGER) AS tag_id
    FROM tokens t LEFT JOIN entities e ON e.sample_id = t.sample_id AND s >= e."start" AND s + length(token) <= e."end" LEFT JOIN ids USING (label))"""


def _leak(test: str, train: str, threshold: float) -> str:
    words = "list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))"
    return f"""WITH a AS (SELECT id, {words} AS ta FROM ({test})), b AS (SELECT id AS doc_id, {words} AS tb FROM ({train})),
      pa AS (SELECT id, len(ta) AS na, unnest(ta) AS w FROM a), pb AS (SELECT doc_id, len(tb) AS nb, unnest(tb) AS w FROM b),
      p AS (SELECT id, doc_id, count(*) AS s, any_value(na) AS na, any_value(nb) AS nb FROM pa JOIN pb USING (w) WHERE nb > {threshold} * na AND na > {threshold} * nb GROUP BY id, doc_id),
      m AS (SELECT id, doc_id, s / (na + nb - s) AS j FROM p WHERE s / (na + nb - s) > {threshold})
      SELECT id AS test_id, min(doc_id) AS train_id, round(arg_min(j, doc_id), 6) AS overlap FROM m GROUP BY id"""


ORACLES = {
    "slot_plan": f"WITH {_SLOTS} SELECT slot, part, label, is_hard_negative FROM slots",
    "batch_plan": f"""WITH {_SLOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY label, is_hard_negative ORDER BY slot) AS rn FROM slots)
        SELECT label, is_hard_negative, (rn - 1) // {f.BATCH_SIZE} AS batch, count(*) AS count, min(slot) AS first_slot FROM r GROUP BY ALL""",
    "topup_plan": f"""WITH m AS (SELECT greatest(0, (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels WHERE quality = 1)) AS n)
        SELECT i AS batch, {_PLAN_LIST}[i % {_L} + 1] AS label, least(n - i * {f.BATCH_SIZE}, {f.BATCH_SIZE}) AS count
        FROM (SELECT n, unnest(range(0, (n + {f.BATCH_SIZE - 1}) // {f.BATCH_SIZE})) AS i FROM m)""",
    "value_synthesis": f"WITH {_SLOTS} SELECT slot, label, is_hard_negative, NOT is_hard_negative AS matches, true AS filled FROM slots WHERE label <> 'NEUTRAL'",
    "injected_samples": f"""WITH {SAMPLES_SQL} SELECT s.sample_id, text, domain, is_hard_negative,
          coalesce((SELECT string_agg(label || ':' || "start" || ':' || "end" || ':' || value, '|' ORDER BY i) FROM entities e WHERE e.sample_id = s.sample_id), '') AS spans FROM samples s""",
    "samples_read_back": f"""WITH {SAMPLES_SQL} SELECT sample_id, text, domain, is_hard_negative,
          (SELECT count(*) FROM entities e WHERE e.sample_id = s.sample_id) AS spans FROM samples s WHERE sample_id % 11 NOT IN (2, 5)""",
    "samples_quarantined": """SELECT CASE (conv_id * 16 + turn) % 11 WHEN 2 THEN 'malformed' ELSE 'missing field' END AS reason, count(*) AS n
        FROM conversations WHERE (conv_id * 16 + turn) % 11 IN (2, 5) GROUP BY 1""",
    "sample_validation": f"WITH {SAMPLES_SQL}, {_CHECKED} SELECT sample_id, reject_reason FROM checked",
    "validation_report": f"""WITH {SAMPLES_SQL}, {_CHECKED} SELECT count(*) FILTER (reject_reason IS NULL) AS sample_counts, count(reject_reason) AS dropped_count,
          count(*) FILTER (reject_reason IS NULL AND is_hard_negative) AS hard_negatives_count,
          round(100.0 * count(*) FILTER (reject_reason IS NULL AND is_hard_negative) / count(*) FILTER (reject_reason IS NULL), 6) AS percent_hard_negatives,
          round(7 / 400::DOUBLE, 6) AS near_dup_rate FROM checked""",
    "sample_domains": f"WITH {SAMPLES_SQL} SELECT domain, count(*) AS samples, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM samples GROUP BY domain",
    "sample_labels": f"WITH {SAMPLES_SQL} SELECT upper(label) AS label, count(*) AS entities, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM entities GROUP BY 1",
    "sample_balance": f"""WITH {SAMPLES_SQL}, n AS (SELECT count(*) AS total FROM samples)
        SELECT 'label' AS kind, label, count(*) AS instances, round(count(*) * 100.0 / any_value(total), 6) AS percent_of_samples FROM entities, n GROUP BY label
        UNION ALL SELECT 'neutral', NULL, count(*), round(count(*) * 100.0 / any_value(total), 6) FROM samples, n WHERE sample_id NOT IN (SELECT sample_id FROM entities)""",
    "harvested_sentences": f"""WITH r AS ({_RAW_LINES}), s AS (SELECT batch_id, CASE
          WHEN form < 3 THEN l
          WHEN form = 3 THEN list_transform(list_filter(list_transform(l, lambda x, i: trim(i || '. ' || x, ' ' || chr(13))), lambda x: x <> ''), lambda x: regexp_replace(x, '^\\d+[\\s.)-]+\\s*', ''))[:{f.BATCH_SIZE}]
          WHEN form = 4 AND len(l) = 1 THEN []
          ELSE list_transform(l, lambda x: trim(x, ' ' || chr(13)))[:{f.BATCH_SIZE}] END AS l FROM r)
        SELECT batch_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS sentence FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM s)""",
    "tagged_ingest": f"SELECT doc_id, 'email address' AS label, \"start\", \"end\", value FROM ({q.spans('documents', 'doc_id', ['email address'])})",
    "tagged_text": "SELECT doc_id, text FROM documents",
    "leakage": _leak(
        "SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        f.LEAKAGE_JACCARD,
    ),
    "leakage_likely": f"""SELECT lang, count(*) AS leaked, true AS recalled FROM documents JOIN (
        {_leak("SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)", "SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", f.LEAKAGE_JACCARD)}
      ) ON test_id = doc_id GROUP BY lang""",
    "leakage_benchmark": _leak("SELECT item_id AS id, text FROM benchmark", "SELECT doc_id AS id, text FROM documents", 0.1),
    "vocab_growth": f"WITH {SAMPLES_SQL}, {_GROWN} SELECT id, tag FROM vocab",
    "vocab_labels": f"""WITH {SAMPLES_SQL}, {_GROWN}, far AS (SELECT CASE WHEN id >= {len(BASE_TAGS)} THEN id + 102 ELSE id END AS id, tag, substring(tag, 3) AS bare FROM vocab WHERE tag <> 'O'),
        named AS (SELECT CASE WHEN bare IN (SELECT bare FROM far WHERE id >= {pii.FIRST_CUSTOM_LABEL_ID}) THEN replace(lower(bare), '_', ' ')
            ELSE {q.canonical_case("replace(bare, '_', '')", 'lower(bare)')} END AS label, id >= {pii.FIRST_CUSTOM_LABEL_ID} AS c FROM far UNION ALL SELECT 'membership card', true)
        SELECT label, bool_or(c) AS is_custom FROM named GROUP BY label""",
    "bio_tags": f"WITH {SAMPLES_SQL}, {_GROWN}, {_BIO} SELECT * FROM bio",
    "class_weights": f"""WITH {SAMPLES_SQL}, {_GROWN}, {_BIO}, c AS (SELECT v.id, tag, count(b.tag_id) AS count FROM vocab v LEFT JOIN bio b ON b.tag_id = v.id GROUP BY v.id, tag),
        w AS (SELECT *, CASE WHEN count > 0 THEN (sum(count) OVER ()) / ((count(*) OVER ()) * count)::DOUBLE ELSE 1.0 END AS w FROM c)
        SELECT id, tag, count, round(least(w / (SELECT w FROM w WHERE id = 0), 10.0), 6) AS weight FROM w""",
    "curve_summary": """WITH l AS (SELECT user_id AS run_id, event_id AS step, value AS loss, CASE WHEN event_id % 3 > 0 THEN value / 1e6 END AS lr FROM events WHERE event_type <> 'signup')
        SELECT run_id, count(*) AS steps, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss,
          round(CASE WHEN arg_min(loss, step) > 0 THEN (arg_min(loss, step) - arg_max(loss, step)) / arg_min(loss, step) * 100 ELSE 0 END, 6) AS reduction_percent,
          round(coalesce((SELECT lr FROM l b WHERE b.run_id = l.run_id ORDER BY step DESC LIMIT 1), 1e-4), 6) AS last_learning_rate FROM l GROUP BY run_id""",
}
