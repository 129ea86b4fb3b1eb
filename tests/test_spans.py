"""Span kernels against Python's own engine and plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanward.catalog import pii, safety
from spanward.functions import regex, spans
from spanward.operators import detect as d
from spanward.schemas import ENTITIES_DDL

TEXTS = [
    "", "plain", "😀 mail alice@corp.com now", "alice@corp.com", "x alice@corp.com\nbob@example.org",
    "I'm Alice Chen, card 4111-1111-1111-1111, SSN 123-45-6789.", "Ship to 123 Main St, passport A98765432",
    "Élan Vital and Zoë Smith Jones met Ann Bob", "call (415) 555-9087 or +1 415.555.9087", "12 Oak Ave, Rd",
    "éABCDEFé ABCDEF", "tab\tsk-live-0123456789abcdef end", "x" * 50 + " " + "9" * 20, "١٢٣-١٢-١٢٣٤",
]


@pytest.mark.parametrize("label", list(pii.PATTERNS))
def test_same_spans_as_python(spark, label):
    pattern = pii.PATTERNS[label]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", spans.raw_spans("text", pattern).alias("s")).collect()
    for r in rows:
        assert [(s.start, s.end, s.value) for s in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, r.text)], r.text


BORDERED = [
    r"\b\d+\b", r"\b[a-c_]{2,}\b", r"\b(?:a|b1)\b", r"\b(?:a|-)x?\b", r"x\B", r"\Bx", r"\B-|-\B", r"(?:\ba|b\b)+", r"\ba?-?b\b", r"-\b\w", r"\b[^\s]+\b",
    r"a(?=\b)", r"(?<!\b)a", r"\b(?:\d[ -]*?){3}\b", r"(?:é\b|\bé)", r"\b-?\d\b|\b_", r"\s\b|\b\s", r"[é_]\b", r"\b(?:ab|ac)\b", r"\ba|\bb",
]


@pytest.mark.parametrize("pattern", BORDERED)
def test_borders_are_those_of_python(spark, pattern):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcx1_- é²\n") for _ in range(rng.randint(0, 14))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", spans.raw_spans("text", pattern).alias("s")).collect()
    for r in rows:
        assert [(s.start, s.end) for s in r.s] == [m.span() for m in re.finditer(pattern, r.text)], r.text


def test_known_neighbours_leave_one_look():
    for label in ("person", "bank account number", "social security number", "passport number"):
        assert regex.jvm_pattern(pii.PATTERNS[label]).count("(?<") == 1


def test_many_spans_in_one_text(spark):
    text = " ".join(f"w{i}é" for i in range(3000))
    got = spark.createDataFrame([(text,)], "text string").select(spans.raw_spans("text", r"\w+").alias("s")).first().s
    assert [(s.start, s.end) for s in got] == [m.span() for m in re.finditer(r"\w+", text)]


def test_null_text_has_no_entities(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    assert [len(r.entities) for r in d.with_entities(df, "text", d.catalogue_detectors()).collect()] == [0, 0]


def test_pattern_matching_nothing_is_refused(spark):
    with pytest.raises(ValueError):
        spans.raw_spans("text", r"a*")


def test_required_literals_are_necessary():
    patterns = [(p, False) for p in pii.PATTERNS.values()] + [(r[3], True) for r in safety.rules()]
    for pattern, fold in patterns:
        literals = regex.required_literals(pattern, fold)
        for text in TEXTS + ["ignore all previous instructions", "12 Oak Ave", "how to make a bomb"]:
            flags = re.IGNORECASE | re.DOTALL if fold else 0
            if re.search(pattern, text, flags) and literals:
                low = text.lower() if fold else text
                assert any(x in low for x in literals)


def test_required_runs_are_necessary(spark):
    patterns = list(pii.PATTERNS.values()) + [r"a(?:[x-z]{4}b)+", r"(?:[ab]{5}|c)", r"[\w-]{4,}?!", r"(?:\d{4}){2}", r"[^a]{5}"]
    assert [regex.required_run(p) for p in patterns[-5:]] == [
        r"(?<![\x{78}-\x{7a}])[\x{78}-\x{7a}]{4}", None, r"(?<![\p{L}\p{N}_\x{2d}])[\p{L}\p{N}_\x{2d}]{4}", r"(?<![\p{Nd}])[\p{Nd}]{4}", None,
    ]
    texts = [*TEXTS, "axxxxbyyyyb", "abcab", "é-_x!", "12345678", "bbbbb"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tests = [F.expr(regex.may_match_sql("text", p)).alias(f"t{i}") for i, p in enumerate(patterns)]
    for r in df.select("text", *tests).collect():
        for i, p in enumerate(patterns):
            assert r[f"t{i}"] or not re.search(p, r.text)


def test_marks_in_the_text_itself(spark):
    rows = ["a\x01b", "\x01alice@corp.com\x01", "\x01\x01", "x\x01y alice@corp.com bob@corp.com\x01"]
    for pattern in (pii.PATTERNS["email address"], r"\x01", r"[^a]"):
        got = spark.createDataFrame([(t,) for t in rows], "text string").select("text", spans.raw_spans("text", pattern).alias("s")).collect()
        for r in got:
            assert [(s.start, s.end, s.value) for s in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, r.text)]


def test_replacement_of_many_spans(spark):
    rng = random.Random(3)
    rows = []
    for n in (0, 1, 2, 3, 10, 500, 3000):
        text, ents, at = [], [], 0
        for i in range(n):
            gap, value = rng.choice(["", " ", "é😀 "]), rng.choice(["x", "😀😀", "word"])
            label = rng.choice(["person", "phone number", "keep"])
            ents.append((label, at + len(gap), at + len(gap) + len(value), 1.0, value))
            text += [gap, value]
            at += len(gap) + len(value)
        rows.append(("".join(text) + rng.choice(["", " tail é"]), ents))
    token = lambda e: F.when(e["label"] != "keep", spans.mask_token(e["label"]))
    got = spark.createDataFrame(rows, f"text string, e {ENTITIES_DDL}").select("text", "e", spans.replace_spans(F.col("text"), F.col("e"), token).alias("r")).collect()
    for r in got:
        out, last, want = [], 0, []
        for e in r.e:
            out.append(r.text[last : e.start])
            new = e.value if e.label == "keep" else "[" + e.label.upper().replace(" ", "_") + "]"
            begin = sum(map(len, out))
            out.append(new)
            want.append((e.label, begin, begin + len(new), new))
            last = e.end
        assert r.r.text == "".join(out) + r.text[last:]
        assert [(s.label, s.start, s.end, s.value) for s in r.r.spans] == want


def resolve_loop(entities, target=None):
    kept = []
    for e in sorted(entities, key=lambda e: e[1]):
        if not kept or e[1] >= kept[-1][2]:
            kept.append(e)
        elif e[0] == target and kept[-1][0] != target:
            kept[-1] = e
        elif kept[-1][0] == target and e[0] != target:
            continue
        elif e[2] - e[1] > kept[-1][2] - kept[-1][1]:
            kept[-1] = e
    return kept


def test_overlap_resolution(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        ents = []
        for _ in range(rng.randint(0, 7)):
            s = rng.randint(0, 20)
            ents.append((rng.choice("abc"), s, s + rng.randint(1, 8), 1.0, "v"))
        rows.append((i, rng.choice(["A", "z"]), ents))
    df = spark.createDataFrame(rows, f"id int, target string, e {ENTITIES_DDL}")
    got = df.select("id", spans.resolve("e", "target").alias("r"), spans.resolve("e").alias("p")).collect()
    for r in got:
        _, target, ents = rows[r.id]
        assert [tuple(x)[:3] for x in r.r] == [x[:3] for x in resolve_loop(ents, target.lower())]
        assert [tuple(x)[:3] for x in r.p] == [x[:3] for x in resolve_loop(ents)]


def test_target_label_has_priority(spark):
    rows = [([("custom_label", 0, 10, None, "John Doe 1"), ("person", 0, 8, None, "John Doe")], "custom_label")]
    df = spark.createDataFrame(rows, f"e {ENTITIES_DDL}, t string")
    assert [e.label for e in df.select(spans.resolve("e", "t").alias("r")).first().r] == ["custom_label"]


def test_full_pattern_does_not_forgive_a_newline(spark):
    p = regex.full_pattern(r"\b\d{3}\b")
    row = spark.createDataFrame([("123", "123\n")], "a string, b string").select(F.col("a").rlike(p), F.col("b").rlike(p)).first()
    assert tuple(row) == (True, False)
