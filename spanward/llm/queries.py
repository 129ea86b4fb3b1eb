"""The numbered operators over their whole tables, with the SQL they are checked against where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, prepare
from . import (
    chat, decontam, filter_audit, html, jaccard, language, packing, secret_ledger, sharding, suffix, topk, toxicity,
    vector_codes,
)

#: A conversation made of control strings, added to those of the table.
HARD_CHAT = r"\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark, sf):
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_CHAT).alias("text"),
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.digests(chat.format_chats(turns))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    return language.identify(docs, language.learn_profiles(docs.where(~language.held_out())))


def op3_decontamination(spark, sf):
    return decontam.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op4_packing(spark, sf):
    return packing.harmonic_pack(table(spark, sf, "documents"), tokenizer_file())


def op5_exact_topk(spark, sf):
    vectors = topk.integer_vectors(table(spark, sf, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op6_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op7_ngram_jaccard_join(spark, sf):
    return jaccard.link_components(table(spark, sf, "documents"), width=3, num=90, den=100).drop("doc_key")


def op8_html_extraction(spark, sf):
    return html.extract(table(spark, sf, "pages"))


def op9_sharding(spark, sf):
    out = sharding.shuffle_into_shards(table(spark, sf, "documents"), 8, seed=9)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op10_suffix_array_dedup(spark, sf):
    return suffix.repeat_digests(table(spark, sf, "documents"))


def op11_secret_ledger(spark, sf):
    ledger = secret_ledger.Ledger(spark, fresh_path(spark, "secret-ledger"))
    return secret_ledger.digests(secret_ledger.scan(table(spark, sf, "documents"), ledger))


def op12_filter_audit(spark, sf):
    return filter_audit.audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op13_vector_codes(spark, sf):
    return vector_codes.compress(table(spark, sf, "embeddings"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        op1_chat_formatting, op2_language_id, op3_decontamination, op4_packing, op5_exact_topk, op6_toxicity,
        op7_ngram_jaccard_join, op8_html_extraction, op9_sharding, op10_suffix_array_dedup,
        op11_secret_ledger, op12_filter_audit, op13_vector_codes,
    )
}

def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def _ledger_sql() -> str:
    """Matches and the gaps between them give every offset by addition."""
    parts = []
    for i, rule in enumerate(secret_ledger.RULES):
        pattern = rule.pattern
        if rule.any_case:
            for word in ("password", "passwd", "secret", "token", "api_?key"):
                pattern = pattern.replace(word + "|", _any_case(word) + "|").replace(word + ")", _any_case(word) + ")")
        pattern = pattern.replace("'", "''")
        parts.append(
            f"SELECT r, {i} AS ord, '{rule.kind}' AS kind, unnest(regexp_extract_all(t, '{pattern}')) AS v, "
            f"unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS g, unnest(list_slice(string_split_regex(t, '{pattern}'), 1, -2)) AS gap, "
            f"{rule.least} AS least, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i FROM d WHERE regexp_matches(t, '{pattern}')"
        )
    base = "ord < 3"
    one = "kind || ':' || (stop - length(v)) || ':' || stop"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
      m AS ({" UNION ALL ".join(parts)}),
      s AS (SELECT *, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY r, ord ORDER BY i) AS BIGINT) AS stop FROM m),
      k AS (SELECT r, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
          string_agg({one}, ',' ORDER BY stop - length(v), ord) FILTER ({base}) AS base, string_agg({one}, ',' ORDER BY stop - length(v), ord) AS spans
        FROM s WHERE length(g) >= least GROUP BY r)
      SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
          sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN k USING (r)"""


def _audit_sql() -> str:
    letters = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l)"
    bits = " + ".join(f"{1 << i} * CAST(contains(substr(o, 1, step - 1), '{c}') AS INT)" for i, c in enumerate("ABCDE"))
    return rf"""WITH d AS (SELECT doc_id AS id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
      w AS (SELECT id, part, t, regexp_extract_all(t, '[^ 	-]+') AS w, min(id) OVER (PARTITION BY t) AS first FROM d),
      l AS (SELECT doc_id AS id, max(CAST(quality = 1 AS INT)) AS g, max(CAST(toxic = 1 AS INT)) AS x FROM labels GROUP BY 1),
      c AS (SELECT part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
            + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS INT)
            + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(id > first AS INT) AS mask,
          count(*) AS n, coalesce(sum(g), 0) AS g, coalesce(sum(x), 0) AS x FROM w LEFT JOIN l USING (id) GROUP BY ALL),
      o AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM {letters} a, {letters} b, {letters} c, {letters} d, {letters} e
        WHERE b.l <> a.l AND c.l NOT IN (a.l, b.l) AND d.l NOT IN (a.l, b.l, c.l) AND e.l NOT IN (a.l, b.l, c.l, d.l)),
      s AS (SELECT o, step, f, 1 << (ascii(f) - 65) AS bit, {bits} AS before FROM (SELECT o, step, substr(o, step, 1) AS f FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step))),
      r AS (SELECT part, o, step, f, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
          sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
          sum(g) FILTER (mask & before = 0 AND mask & bit > 0) AS good, sum(x) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic
        FROM c, s GROUP BY ALL)
      SELECT part, o AS filter_order, step, {", ".join(f"CAST(coalesce({a}, 0) AS BIGINT) AS {b}" for a, b in (("kept", "kept"), ("removed", "removed"),
        ("redundant", "redundant"), ("unique_fails", "unique_fails"), ("good", "good_lost"), ("toxic", "toxic_lost")))},
        CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM r"""


def _codes_sql() -> str:
    apart = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in (1, 2):
        steps.append(f"""
      n{i} AS (SELECT p, r, any_value(x) AS x, min({apart} * 64 + e) % 64 AS e FROM q JOIN b{i - 1} USING (p) GROUP BY p, r),
      m{i} AS (SELECT p, e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS y FROM n{i}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM q))) AS j) GROUP BY p, e, j),
      b{i} AS (SELECT p, e, coalesce(y, c) AS c FROM b{i - 1} LEFT JOIN (SELECT p, e, list(y ORDER BY j) AS y FROM m{i} GROUP BY p, e) USING (p, e)),""")
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label,
          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      q AS (SELECT r, p, list_slice(v, p * len(v) // 16 + 1, (p + 1) * len(v) // 16) AS x FROM k, (SELECT unnest(range(16)) AS p)),
      b0 AS (SELECT p, r AS e, x AS c FROM q WHERE r < 64),{"".join(steps)}
      f AS (SELECT p, r, min({apart} * 64 + e) AS m FROM q JOIN b2 USING (p) GROUP BY p, r),
      g AS (SELECT r, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM f GROUP BY r),
      h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN g USING (r), h"""


ORACLES = {
    "op1_chat_formatting": rf"""WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{HARD_CHAT}' FROM range(2) t(i)),
      parts AS (SELECT *, length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: '
            WHEN 'assistant' THEN '### Assistant: ' END)
          + length(regexp_replace(replace(text, '\', '\\'), '#(## )|<(/turn>)|<(/role>)', 'x\1\2\3_', 'g')) + 8 AS size FROM rows),
      folded AS (SELECT conv_id, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
          coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
          string_agg(role, ' ' ORDER BY turn, role, text) AS roles, count(*) AS n_turns, CAST(sum(size) AS BIGINT) AS formatted_chars
          FROM parts GROUP BY conv_id)
      SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
          formatted_chars, regexp_full_match(roles, '(system )?user assistant( user assistant)*') AS valid FROM folded""",
    "op5_exact_topk": """WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
      SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op11_secret_ledger": _ledger_sql(),
    "op12_filter_audit": _audit_sql(),
    "op13_vector_codes": _codes_sql(),
}
