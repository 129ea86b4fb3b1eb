"""Reference SQL, in DuckDB's dialect, used to check the Spark queries."""

from __future__ import annotations

from ..catalog import pii, safety

# Letters outside ASCII. That engine's word boundary knows ASCII only, so they are turned into a Z, a word character
# that the patterns' classes are cut short of; a real Z becomes a Y first, which no pattern tells apart.
_LETTERS = (
    r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{370}-\x{1FFF}\x{3040}-\x{D7FF}]"
)


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def asciified(text: str) -> str:
    return f"regexp_replace(replace({text}, 'Z', 'Y'), '{_LETTERS}', 'Z', 'g')"


def asciified_pattern(pattern: str) -> str:
    return quote(pattern.replace("A-Z", "A-Y"))


def spans(table: str, keys: str, labels: list[str], text: str = "text", where: str = "true") -> str:
    """Rows (keys, ord, label, start, end, value) of every match of the labels' patterns."""
    parts = []
    for i, label in enumerate(labels):
        pattern = asciified_pattern(pii.PATTERNS[label])
        parts.append(
            f"""SELECT {keys}, {i} AS ord, {quote(label)} AS label,
              CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS "start",
              CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(v[1:i], lambda x: length(x))) AS INTEGER) AS "end", source
            FROM (SELECT {keys}, source, v, g, unnest(range(1, len(v) + 1)) AS i
              FROM (SELECT {keys}, {text} AS source, regexp_extract_all({asciified(text)}, {pattern}) AS v,
                           string_split_regex({asciified(text)}, {pattern}) AS g
                    FROM {table} WHERE {where}) WHERE len(v) > 0)"""
        )
    union = "\nUNION ALL\n".join(parts)
    return f"""SELECT {keys}, ord, label, "start", "end", substring(source, "start" + 1, "end" - "start") AS value FROM ({union})"""


def resolved(table: str, keys: str, labels: list[str], text: str = "text", where: str = "true") -> str:
    """The same without overlaps: (keys, i, label, start, end, value)."""
    return f"""SELECT {keys}, i, r[i].label AS label, r[i]."start" AS "start", r[i]."end" AS "end", r[i].value AS value
    FROM (SELECT {keys}, r, unnest(range(1, len(r) + 1)) AS i FROM (
      SELECT {keys}, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x:
        CASE WHEN x[1]."start" >= acc[-1]."end" THEN acc || x
             WHEN x[1]."end" - x[1]."start" > acc[-1]."end" - acc[-1]."start" THEN acc[:-2] || x
             ELSE acc END) AS r
      FROM (SELECT {keys}, list({{'label': label, 'start': "start", 'end': "end", 'value': value}} ORDER BY "start", ord) AS l
            FROM ({spans(table, keys, labels, text, where)}) GROUP BY {keys})))"""


def action_case(actions: dict, default: str, label: str = "label") -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in actions.items())
    return f"CASE {label} {whens} ELSE {quote(default)} END" if actions else quote(default)


def redacted(
    table: str, keys: str, labels: list[str], actions: dict, default: str, phrases: dict | None = None,
    text: str = "text", where: str = "true", extra: str = "",
) -> str:
    """(keys, extra, text, clean_text, modified, blocked, reason)."""
    token = "'[' || replace(upper(label), ' ', '_') || ']'"
    rewrites = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in (phrases or {}).items())
    rewritten = f"CASE label {rewrites} ELSE {token} END" if rewrites else token
    on = " AND ".join(f"t.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    on_c = on.replace("b.", "c.")
    return f"""SELECT t.*, coalesce(c.clean, t.text) AS clean_text, coalesce(c.clean, t.text) <> t.text AS modified,
        b.reason IS NOT NULL AS blocked, b.reason
      FROM (SELECT {keys}{extra}, {text} AS text FROM {table} WHERE {where}) t
      LEFT JOIN (SELECT {keys}, string_agg(label, ', ' ORDER BY label) AS reason
                 FROM (SELECT DISTINCT {keys}, label FROM spans WHERE action = 'BLOCK') GROUP BY {keys}) b ON {on}
      LEFT JOIN (SELECT {keys}, string_agg(substring(text, prev + 1, "start" - prev) || new, '' ORDER BY "start")
                        || substring(any_value(text), max("end") + 1) AS clean
                 FROM (SELECT s.*, d.text,
                         CASE action WHEN 'MASK' THEN {token} WHEN 'REWRITE' THEN {rewritten} END AS new,
                         coalesce(lag("end") OVER (PARTITION BY {', '.join('s.' + k.strip() for k in keys.split(','))} ORDER BY "start"), 0) AS prev
                       FROM spans s JOIN (SELECT {keys}, {text} AS text FROM {table} WHERE {where}) d USING ({keys})
                       WHERE action IN ('MASK', 'REWRITE'))
                 GROUP BY {keys}) c ON {on_c} AND b.reason IS NULL"""


def redaction_cte(table: str, keys: str, labels: list[str], actions: dict, default: str, text: str = "text", where: str = "true") -> str:
    return f"""spans AS MATERIALIZED (SELECT *, {action_case(actions, default)} AS action
      FROM ({resolved(table, keys, labels, text, where)}))"""


def rule_case(text: str, enabled: list[str] | None = None, rules: list[tuple] | None = None) -> str:
    """Number of the first rule that hits, in order."""
    whens = []
    for guard, _, ord_, pattern, _ in safety.rules() if rules is None else rules:
        if enabled is not None and guard not in enabled:
            continue
        if "(?!assistant|AI)" in pattern:
            free = pattern.replace("(?!assistant|AI)", "")
            held = pattern.replace("(?!assistant|AI)", "(assistant|AI)")
            test = f"regexp_matches({text}, {quote(free)}, 'is') AND NOT regexp_matches({text}, {quote(held)}, 'is')"
        else:
            test = f"regexp_matches({text}, {quote(pattern)}, 'is')"
        whens.append(f"WHEN {test} THEN {ord_}")
    return "CASE " + "\n".join(whens) + " END"


def rule_table(actions: dict | None = None) -> str:
    actions = actions or {}
    rows = ", ".join(
        f"({ord_}, {quote(guard)}, {quote(tier)}, {quote(reason)}, {str(actions.get(guard, 'BLOCK') == 'BLOCK').lower()})"
        for guard, tier, ord_, _, reason in safety.rules()
    )
    return f"rules(rule, guard, tier, reason, block) AS (VALUES {rows})"


def canonical_case(squeezed: str, fallback: str) -> str:
    whens = [
        "WHEN " + " OR ".join(f"contains({squeezed}, '{f}')" for f in fragments) + f" THEN {quote(name)}"
        for fragments, name in pii.CANONICAL_RULES
    ]
    return "CASE " + " ".join(whens) + f" ELSE {fallback} END"
