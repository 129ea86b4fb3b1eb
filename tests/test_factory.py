"""Plans, values, injection, validation, sources, near-duplicates, leakage."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanward.catalog import factory as f
from spanward.catalog import pii
from spanward.operators import inject as inj
from spanward.operators import leakage as leak
from spanward.operators import minhash
from spanward.operators import neardup, quality, slots, values
from spanward.schemas import ENTITIES_DDL, SAMPLES
from spanward.sources import generated, samples as src

PATTERNS = [*pii.PATTERNS.values(), r"PT-[0-9]{5}-[A-Z]{2}", r"PIN-[0-9]{4}", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"^(?:ab|c[^x]d)?e{2,3}\w*$"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_values_match_and_negatives_do_not(spark, pattern):
    ids = spark.range(60)
    rows = ids.select("id", values.pattern_value(pattern, F.col("id"), 5).alias("v"))
    rows = rows.withColumn("bad", values.perturbed(F.col("v"), pattern, F.col("id"), 9)).collect()
    for r in rows:
        assert re.fullmatch(pattern, r.v), r.v
        assert not re.fullmatch(pattern, r.bad) and r.bad.strip() and r.bad != r.v
    assert len({r.v for r in rows}) > (3 if "Ave" in pattern else 20)


def test_values_do_not_depend_on_partitions(spark):
    def draw(n):
        df = spark.range(0, 40, 1, n).select("id", values.pattern_value(pii.PATTERNS["email address"], F.col("id"), 1).alias("v"))
        return {r.id: r.v for r in df.collect()}

    assert draw(1) == draw(7)


def test_special_values(spark):
    row = spark.range(1).select(
        values.plain_value("API_KEY", F.col("id")).alias("key"), values.plain_value("who knows", F.col("id")).alias("num"),
        values.perturbed(F.lit("12"), None, F.col("id")).alias("zero"), values.perturbed(F.lit("12"), "(", F.col("id")).alias("xyz"),
        values.perturbed(F.lit("12"), r"[\s\S]+", F.col("id")).alias("always"), values.plain_value("address", F.col("id")).alias("addr"),
    ).first()
    assert re.fullmatch(r"sk-live-[0-9a-f]{16}", row.key) and re.fullmatch(r"[1-9][0-9]{11}", row.num)
    assert row.zero == "120" and row.xyz == "12XYZ" and row.always in ("12_invalid", f.EMPTIED_VALUE) and "\n" not in row.addr
    with pytest.raises(ValueError):
        values.pattern_value(r"(a)\1", F.lit(1))


def test_slot_quotas(spark):
    configs = slots.label_configs(["person", "patient id", "phone number"], {"Patient ID": "PT-[0-9]{5}-[A-Z]{2}"})
    assert configs[1][1] == "PT-[0-9]{5}-[A-Z]{2}" and configs[0][1] == pii.PATTERNS["person"]
    plan = slots.plan_slots(spark, 101, configs).collect()
    by = lambda label: [r for r in plan if r.label == label]
    assert len(by("NEUTRAL")) == 10 and [len(by(c[0])) for c in configs] == [31, 30, 30]
    for label, _ in configs:
        quota = [r for r in by(label) if r.part == "quota"]
        assert len(quota) == 30 and sum(r.is_hard_negative for r in quota) == 3
    assert all(r.label == "NEUTRAL" for r in slots.plan_slots(spark, 5, []).collect())
    assert {r.domain for r in slots.plan_slots(spark, 300, configs, domains=f.HELD_OUT_DOMAINS).collect()} == set(f.HELD_OUT_DOMAINS)


def test_batches_and_topup(spark):
    plan = slots.plan_slots(spark, 200, slots.label_configs(["person"]))
    batches = slots.plan_batches(plan).collect()
    assert sum(b["count"] for b in batches) == 200 and max(b["count"] for b in batches) == 15
    first = {r.slot: r.domain for r in plan.collect()}
    assert all(b.domain == first[b.first_slot] for b in batches)
    extra = slots.plan_topup(spark.range(100), spark.range(68), slots.label_configs(["person", "my label"])).orderBy("batch").collect()
    assert [(b.label, b["count"]) for b in extra] == [("person", 15), ("my label", 15), ("person", 2)]
    assert extra[0].domain == pii.DATA_FORMATS["person"]
    assert slots.plan_topup(spark.range(10), spark.range(12), []).count() == 0
    many = slots.plan_topup(spark.range(400_003), spark.range(0), [], batch_size=15)
    assert many.agg(F.sum("count"), F.count("*"), F.max("batch")).first()[:3] == (400_003, 26_667, 26_666)


def test_injection(spark):
    rows = [
        (1, "Ask [PII] or [PII]!", "SSN", False, ["123-45-6789", "2"]), (2, "no place", "SSN", False, ["9"]), (3, "no place ", "SSN", False, ["9"]),
        (4, "a [PII]", "SSN", True, ["x"]), (5, "none", "SSN", True, ["x"]), (6, "keep [PII]", "neutral", False, ["x"]), (7, "", "SSN", False, ["7"]),
        (8, "😀[PII]", "SSN", False, ["8"]), (9, "Call [PII] now", "SSN", True, ["V1", "V2"]), (10, "end [PII] ", "SSN", True, ["V1", "V2"]),
    ]
    df = spark.createDataFrame(rows, "slot long, sentence string, label string, is_hard_negative boolean, values array<string>")
    got = {r.slot: (r.text, [tuple(e)[:3] + (e.value,) for e in r.entities]) for r in inj.inject(df).collect()}
    assert got[1] == ("Ask 123-45-6789 or 2!", [("ssn", 4, 15, "123-45-6789"), ("ssn", 19, 20, "2")])
    assert got[2] == ("no place 9", [("ssn", 9, 10, "9")]) and got[3] == ("no place 9", [("ssn", 9, 10, "9")])
    assert got[4] == ("a x x", []) and got[9] == ("Call V1 now V2", []) and got[10] == ("end V1 V2", []) and got[5] == ("none x", []) and got[6] == ("keep [PII]", []) and got[7] == ("7", [("ssn", 0, 1, "7")])
    assert got[8] == ("😀8", [("ssn", 1, 2, "8")])
    crossed = {r.slot: [e.label for e in r.entities] for r in inj.inject(df, cross_label=True).collect()}
    assert crossed[1][0] == "ssn" and "neutral" not in crossed[6]


def test_validation(spark):
    rows = [
        (1, "id 1234 x", [("pin", 3, 7, None, "1234")], False), (2, "id 1234 x", [("pin", 2, 7, None, "1234")], False),
        (3, "id 12a4 x", [("PIN", 3, 7, None, "12a4")], True), (4, "free", [], True), (5, "odd (", [("odd", 4, 5, None, "(")], False),
    ]
    df = spark.createDataFrame(rows, f"sample_id long, text string, entities {ENTITIES_DDL}, is_hard_negative boolean")
    configs = [("pin", r"\d{4}"), ("odd", "(")]
    good, bad = quality.validate(df, configs)
    assert sorted(r.sample_id for r in good.collect()) == [1, 4, 5]
    assert {r.sample_id: r.reject_reason for r in bad.collect()} == {2: "offset", 3: "pattern"}
    report = quality.generation_report(quality.checked(df, configs), 10, 3).first()
    assert (report.sample_counts, report.dropped_count, report.hard_negatives_count) == (3, 2, 1)
    assert report.percent_hard_negatives == pytest.approx(100 / 3) and report.near_dup_rate == 0.3
    empty = quality.generation_report(quality.checked(df.filter("false")), 0).first()
    assert empty.percent_hard_negatives == 0.0 and empty.near_dup_rate == 0.0


def harvest_loop(raw, size=15):
    content = raw
    m = re.search(r"(\[.*\])", content, re.DOTALL)
    o = re.search(r"(\{.*\})", content, re.DOTALL)
    if m:
        content = m.group(1).strip()
    elif o:
        content = "[" + o.group(1).strip() + "]"
    else:
        if content.startswith("```"):
            content = re.sub(r"\n?```$", "", re.sub(r"^```(?:json)?\n?", "", content))
        content = content.strip()
    try:
        parsed = json.loads(content)
        return [str(x) for x in parsed] if isinstance(parsed, list) else []
    except ValueError:
        out = []
        for line in content.split("\n"):
            line = line.strip()
            if not line or line.startswith(("```", "[")) or line.endswith("]"):
                continue
            line = re.sub(r"^\d+[\s.)-]+\s*", "", line)
            if len(line) > 0 and line[0] == line[-1] and line[0] in "\"'":
                line = line[1:-1].strip()
            out.append(line)
        return out[:size]


def test_harvest(spark):
    raws = [
        '["a","b [PII]"]', 'Sure!\n["a", "é"]\nbye', "```json\n[\"x\"]\n```", "1. first\n2) second\n\n- third", '["a", "b"', "",
        "['a']", '["a",]', '["a"] and ["b"]', "```\n1. one\n'two'\n```", "[\n\"a\n\"\n]", "plain", '"lone"', "12", "[]", '["\\u00e9", null]',
        "\n".join(f"{i}. s{i}" for i in range(20)), "[a\nmid\nb]",
    ]
    df = spark.createDataFrame(list(enumerate(raws)), "batch_id int, raw string")
    got = {r.batch_id: r.s for r in df.select("batch_id", generated.harvested(F.col("raw")).alias("s")).collect()}
    for i, raw in enumerate(raws):
        assert got[i] == harvest_loop(raw), raw


def test_tagged_text(spark):
    tagged = "My <person>John Doe</person> mail < Email Address >j@d.com</ Email Address > <a>x</b> <t></t>\n<x>two\nlines</x>"
    row = generated.ingest_tagged(spark.createDataFrame([(tagged,)], "raw string"), "raw").first()
    clean, spans, last = "", [], 0
    for m in re.finditer(r"<([a-zA-Z0-9_\- ]+?)>(.*?)</\1>", tagged):
        clean += tagged[last : m.start()]
        spans.append((m.group(1).strip().lower(), len(clean), len(clean) + len(m.group(2))))
        clean += m.group(2)
        last = m.end()
    assert row.text == clean + tagged[last:] and [tuple(e)[:3] for e in row.entities] == spans


def test_samples_quarantine(spark, tmp_path):
    good = [{"text": "a", "entities": [{"label": "x", "start": 0, "end": 1}]}, {"text": "b", "entities": [], "domain": "HR", "is_hard_negative": True}, {"text": "c"}]
    (tmp_path / "ok.json").write_text(json.dumps(good))
    (tmp_path / "bad.json").write_text("y" + json.dumps(good))
    kept, held = src.read_samples(spark, str(tmp_path))
    rows = {r.text: r for r in kept.collect()}
    assert set(rows) == {"a", "b"} and rows["a"].domain == "Unknown" and rows["b"].is_hard_negative and not rows["a"].is_hard_negative
    assert sorted(r.reason for r in held.collect()) == ["malformed", "missing field"]
    src.write_samples(kept, str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).schema.fieldNames() == SAMPLES.fieldNames()
    (tmp_path / "lines.jsonl").write_text('{"text": "a", "entities": []}\nnot json\n')
    kept, held = src.read_samples(spark, str(tmp_path / "lines.jsonl"), lines=True)
    assert kept.count() == 1 and held.first().reason == "malformed"
    src.write_eval(spark.createDataFrame([("r", 1.0)], "run_id string, f1 double"), str(tmp_path / "eval"))
    assert spark.read.json(str(tmp_path / "eval")).first().run_id == "r"


def test_near_duplicates(spark):
    a, b, c = "Please reset the password for [PII].", "Please reset the passcode for [PII].", "The user reported an error on the homepage."
    df = spark.createDataFrame([(1, [a, b, c, "  ", a])], "batch_id int, sentences array<string>")
    row = neardup.drop_near_duplicates(df, threshold=0.80).first()
    assert row.accepted == [a, c] and row.near_dups == 3


def test_near_duplicates_follow_the_plain_ratio():
    from difflib import SequenceMatcher

    rng = random.Random(1)
    for _ in range(30):
        batch = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 12))) for _ in range(15)]
        kept = []
        for x in batch:
            x = x.strip()
            if x and not any(SequenceMatcher(None, x.lower(), k.lower()).ratio() > 0.7 for k in kept):
                kept.append(x)
        assert neardup.keep_first(batch, 0.7) == kept


@pytest.mark.parametrize("threshold, rows", [(0.5, 7), (0.45, 8192), (0.8, 50)])
def test_signatures_leave_few_pairs_in_doubt_and_miss_none(spark, monkeypatch, threshold, rows):
    """Prefix postings met in every pair with a common word, which grew with the product of both sides."""
    monkeypatch.setattr(leak, "CELL_ROWS", rows)
    rng, sets = random.Random(5), []
    for i in range(120):
        base = {f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 7, 8, 15, 16, 31, 32, 63, 200, 700]))}
        sets += [base, {*list(base)[: max(1, int(len(base) * rng.random()))], "every", "text"}]
    kind = "id string, tokens array<string>, n int"
    a, b = ([(f"{side}{i}", sorted(x), len(x)) for i, x in enumerate(sets) if i % 2 == side] for side in (0, 1))
    signed = [spark.createDataFrame(x, kind).select("id", "n", leak.signature(F.col("tokens")).alias("sig")) for x in (a, b)]
    got = {tuple(r) for r in leak.signed_candidates(*signed, threshold).collect()}
    similar = {(i, j): len({*x} & {*y}) / len({*x} | {*y}) for i, x, _ in a for j, y, _ in b}
    assert {k for k, s in similar.items() if s > threshold} <= got
    assert len(got) < 3 * sum(s > threshold - 0.15 for s in similar.values()) + 30
    met = signed[0].selectExpr("id AS test_id").crossJoin(signed[1].selectExpr("id AS train_id"))
    assert {tuple(r) for r in leak.plausible(met, *signed, threshold).collect()} == got


@pytest.mark.parametrize("threshold, rows, wave, top", [(0.5, 9, 1, 2000), (0.5, 32768, 2_000_000_000, 2000), (0.45, 40, 30_000, 300), (0.8, 32768, 2_000_000_000, 20)])
def test_marks_of_rare_tokens_miss_no_similar_pair(spark, monkeypatch, threshold, rows, wave, top):
    """All signatures of a cell met before; few blocks or many, one wave or many, rare tokens or none."""
    monkeypatch.setattr(leak, "CELL_ROWS", rows)
    monkeypatch.setattr(leak, "WAVE", wave)
    rng, sets = random.Random(3), []
    for _ in range(90):
        size = rng.choice([1, 2, 3, 7, 8, 12, 31, 48, 90, 200, 400])
        base = [f"w{int(top * rng.random() ** 3)}" for _ in range(size)]
        near = [w for w in base if rng.random() < 0.85] + [f"w{rng.randrange(top)}" for _ in range(size // 8)]
        sets += [{*base}, {*near, "every"}]
    kind = "id string, tokens array<string>, n int"
    rows = [[(f"{side}-{i}", sorted(x), len(x)) for i, x in enumerate(sets) if i % 2 == side] for side in (0, 1)]
    a, b = (spark.createDataFrame(x, kind) for x in rows)
    counts = leak.token_counts(a)
    sides = [x.select("id", "n", leak.signature(F.col("tokens")).alias("sig"), leak.rare_marks(F.col("tokens"), counts, threshold).alias("marks")) for x in (a, b)]
    got = [tuple(r) for r in leak.signed_candidates(*sides, threshold).collect()]
    similar = {(i, j) for i, x, _ in rows[0] for j, y, _ in rows[1] if len({*x} & {*y}) / len({*x} | {*y}) > threshold}
    assert len(similar) > 20 and similar <= {*got} and len(got) == len({*got})
    unmarked = {tuple(r) for r in leak.signed_candidates(*(x.drop("marks") for x in sides), threshold).collect()}
    assert {*got} <= unmarked
    assert leak.signed_candidates(sides[0].limit(0), sides[1], threshold).collect() == []


def test_band_keys_are_those_of_sql_and_pairs_share_one(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PERMUTED", 64)
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        texts.append([f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 5, 20, 40]))])
        texts.append([w if rng.random() < 0.8 else f"w{rng.randrange(500)}" for w in texts[-1]])
    rows = [(i, sorted({*x}), len({*x})) for i, x in enumerate(texts)]
    bands, per = 4, 2

    def least(k):
        return F.array_min(F.transform("tokens", lambda t: F.xxhash64(F.xxhash64(t), F.lit(k))))

    keys = F.array(*[F.xxhash64(F.lit(b).cast("long"), *[least(b * per + j) for j in range(per)]) for b in range(bands)])
    want, sides = {}, []
    for side in (0, 1):
        df = spark.createDataFrame(rows[side::2], "id long, tokens array<string>, n int")
        sides.append(df.select("id", "n", keys.alias("want"), minhash.band_keys(F.col("tokens"), bands, per).alias("marks"), leak.signature(F.col("tokens")).alias("sig")))
        for r in sides[-1].collect():
            assert r.marks == b"".join(k.to_bytes(8, "little", signed=True) for k in r.want)
            want[r.id] = {*r.want}
    got = {tuple(r) for r in leak.signed_candidates(*(x.select("id", "n", "sig", "marks") for x in sides), 0.5, banded=True).collect()}
    every = {tuple(r) for r in leak.signed_candidates(*(x.select("id", "n", "sig") for x in sides), 0.5).collect()}
    assert {*()} < got == {(i, j) for i, j in every if want[i] & want[j]} < every


@pytest.mark.parametrize("threshold, shares", [(0.5, (1.0,)), (0.5, (0.25, 0.5, 0.75, 1.0)), (0.2, leak.BLOCKS), (0.8, (1.0,))])
def test_leakage_equals_all_pairs(spark, monkeypatch, threshold, shares):
    """Random texts, copies, near-copies of one text on both sides; one block and several."""
    monkeypatch.setattr(leak, "BLOCKS", shares)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    seed = [rng.choice(words) for _ in range(12)]

    def text():
        if rng.random() < 0.4:
            return " ".join(w if rng.random() < 0.8 else rng.choice(words) for w in seed)
        return " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))

    train = [(i, text().upper() if i % 2 else text()) for i in range(120)] + [(200, ""), (201, None)]
    test = [(i, text()) for i in range(60)] + [(90, train[5][1]), (91, train[5][1] + " "), (92, "")]
    got = leak.leakage(
        spark.createDataFrame(test, "a long, text string"), spark.createDataFrame(train, "b long, text string"), "a", "b", threshold=threshold
    ).collect()
    want = {}
    for i, t in test:
        x = set(t.lower().split())
        for j, u in sorted(train):
            y = set((u or "").lower().split())
            if x and y and len(x & y) / len(x | y) > threshold:
                want[i] = (j, round(len(x & y) / len(x | y), 9))
                break
    assert {r.test_id: (r.train_id, round(r.overlap, 9)) for r in got} == want


def test_banded_search_finds_most_of_what_is_alike(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(60)]
    near = [[w if rng.random() < 0.9 else rng.choice(words) for w in b] for b in base]
    train = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(base)] + [(100, None), (101, " ")], "b long, text string")
    test = spark.createDataFrame([(i, " ".join(b), "xy"[i % 2]) for i, b in enumerate(near)] + [(200, "", "x"), (201, "w1 other", "y")], "a long, text string, g string")
    exact, likely = leak.leakage(test, train, "a", "b"), minhash.likely_leakage(test, train, "a", "b")
    want = {r.test_id: (r.train_id, round(r.overlap, 9)) for r in exact.collect()}
    got = {r.test_id: (r.train_id, round(r.overlap, 9)) for r in likely.collect()}
    assert len(want) > 50 and got.items() <= want.items() and len(got) >= 0.9 * len(want)
    rates = {r.g: (r.leaked, r.found) for r in minhash.recall(exact, likely, test, "a", "g").collect()}
    assert sum(n for n, _ in rates.values()) == len(want) and sum(n for _, n in rates.values()) == len(got)
