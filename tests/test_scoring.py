"""Matching, metrics, tags, weights against plain loops."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from spanward.functions import matching
from spanward.operators import evaluate as e
from spanward.operators import tagging, training
from spanward.schemas import ENTITIES_DDL

PAIRS_DDL = f"run_id string, sample_id long, text string, domain string, truth {ENTITIES_DDL}, pred {ENTITIES_DDL}"


def iou(a, b):
    hull = max(a[2], b[2]) - min(a[1], b[1])
    return max(0, min(a[2], b[2]) - max(a[1], b[1])) / hull if hull > 0 else 0.0


def greedy(pred, truth):
    used, out = set(), {}
    for i in sorted(range(len(pred)), key=lambda i: -(pred[i][3] or 0)):
        best, score = -1, 0.0
        for j, t in enumerate(truth):
            v = iou(pred[i], t)
            if j not in used and v >= 0.5 and v > score:
                best, score = j, v
        out[i] = best
        used.add(best)
    return out


def painted(n, ents):
    chars = ["O"] * n
    for label, s, t, *_ in ents:
        for i in range(max(0, s), min(n, t)):
            chars[i] = label
    return chars


def random_pairs(n, seed):
    rng = random.Random(seed)

    def ents():
        out = []
        for _ in range(rng.randint(0, 6)):
            s = rng.randint(0, 18)
            out.append((rng.choice("xyz"), s, s + rng.randint(1, 6), rng.choice([0.5, 0.5, 0.9]), "v"))
        return sorted(out, key=lambda x: x[1])

    return [("r", i, "t" * rng.randint(0, 20), "d", ents(), ents()) for i in range(n)]


def test_matching_and_painting(spark):
    rows = random_pairs(500, 3)
    df = spark.createDataFrame(rows, PAIRS_DDL)
    got = df.select(
        "sample_id", matching.greedy_pairs(F.col("pred"), F.col("truth")).alias("m"),
        matching.agreeing_chars(F.char_length("text"), F.col("truth"), F.col("pred")).alias("c"),
    ).collect()
    for r in got:
        _, _, text, _, truth, pred = rows[r.sample_id]
        assert {m.i: m.j for m in r.m} == greedy(pred, truth)
        assert r.c == sum(a == b for a, b in zip(painted(len(text), truth), painted(len(text), pred)))


@pytest.mark.parametrize("step, length", [(7, 10), (20, 10), (1, 2)])
def test_matching_of_very_many_spans(spark, step, length):
    rng = random.Random(step)
    truth = [("x", i * step + rng.randint(0, 3), 0, 0.5, "v") for i in range(10_000)]
    truth = [(a, s, s + length + rng.randint(-1, 3), p, v) for a, s, _, p, v in truth]
    pred = [(a, s + rng.randint(-2, 2), e + rng.randint(-1, 2), rng.choice([0.5, 0.6, 0.9]), v) for a, s, e, _, v in truth if rng.random() < 0.95]
    rng.shuffle(pred)
    row = spark.createDataFrame([("r", 1, "t", "d", truth, pred)], PAIRS_DDL).select(matching.greedy_pairs(F.col("pred"), F.col("truth")).alias("m")).first()
    starts = sorted((t[1], j) for j, t in enumerate(truth))
    used, want = set(), {}
    for i in sorted(range(len(pred)), key=lambda i: -pred[i][3]):
        near = starts[bisect.bisect_left(starts, (pred[i][1] - 40, -1)) : bisect.bisect_left(starts, (pred[i][2] + 40, -1))]
        able = [(-iou(pred[i], truth[j]), j) for _, j in near if j not in used and iou(pred[i], truth[j]) >= 0.5]
        want[i] = min(able)[1] if able else -1
        used.add(want[i])
    assert {m.i: m.j for m in row.m} == want


def test_metrics(spark):
    rows = random_pairs(200, 4)
    matches = e.match_spans(spark.createDataFrame(rows, PAIRS_DDL))
    count = {}

    def add(label, **k):
        c = count.setdefault(label, dict(tp=0, fp=0, fn=0, support=0))
        for key, v in k.items():
            c[key] += v

    for _, _, _, _, truth, pred in rows:
        pairs = greedy(pred, truth)
        for i, j in pairs.items():
            if j < 0:
                add(pred[i][0], fp=1)
            elif pred[i][0] == truth[j][0]:
                add(truth[j][0], tp=1, support=1)
            else:
                add(pred[i][0], fp=1)
                add(truth[j][0], fn=1, support=1)
        for j, t in enumerate(truth):
            if j not in pairs.values():
                add(t[0], fn=1, support=1)
    metrics = e.entity_metrics(matches)
    got = {r.label: r for r in metrics.collect()}
    assert {k: {c: got[k][c] for c in v} for k, v in count.items()} == count
    s = e.summary_metrics(metrics).first()
    tp, fp, fn = (sum(c[k] for c in count.values()) for k in ("tp", "fp", "fn"))
    assert s.micro_precision == pytest.approx(tp / (tp + fp)) and s.micro_recall == pytest.approx(tp / (tp + fn))
    assert s.macro_f1 == pytest.approx(sum(r.f1 for r in got.values()) / len(got))
    wide = e.confusion_matrix(e.confusion(matches), ["x", "y", "z"]).collect()
    assert len(wide) == 3 and sum(r.x + r.y + r.z for r in wide) == sum(j >= 0 for row in rows for j in greedy(row[5], row[4]).values())


def test_perfect_predictions_and_empty_input(spark):
    rows = [("r", i, "abcdef", "d", [("x", 0, 3, 1.0, "abc")], [("x", 0, 3, 1.0, "abc")]) for i in range(3)] + [("r", 9, "", "d", [], [])]
    df = spark.createDataFrame(rows, PAIRS_DDL)
    m = e.entity_metrics(e.match_spans(df)).first()
    assert (m.precision, m.recall, m.f1) == (1.0, 1.0, 1.0) and e.char_accuracy(df).first().accuracy == 1.0
    empty = spark.createDataFrame([("r", 9, "", "d", [], [])], PAIRS_DDL)
    assert e.char_accuracy(empty).first().accuracy == 1.0 and e.entity_metrics(e.match_spans(empty)).count() == 0


def test_iou_of_one_half_is_accepted(spark):
    df = spark.createDataFrame([("r", 1, "abcd", "d", [("x", 0, 4, None, "")], [("x", 0, 2, 0.9, "")])], PAIRS_DDL)
    assert e.match_spans(df).first().matched[0].iou == 0.5


def test_errors_between_runs(spark):
    t = [("x", 0, 4, None, "")]
    rows = []
    for i in range(6):
        rows += [("base", i, "abcdefgh", "d", t, []), ("new", i, "abcdefgh", "d", t, [("y", 0, 4, 0.9, ""), ("x", 5, 8, 0.9, "")])]
    matches = e.match_spans(spark.createDataFrame(rows, PAIRS_DDL))
    out = e.error_analysis(matches, "base", "new").collect()
    assert [r.sample_id for r in out if r.kind == "fixed_miss"] == [0, 1, 2, 3, 4]
    assert len([r for r in out if r.kind == "new_false_positive"]) == 5
    assert e.error_analysis(matches, "base", "new", None).count() == 12
    diff = {r.label: r.change for r in e.compare_runs(e.entity_metrics(matches), "base", "new").collect()}
    assert diff == {"x": "same", "y": "same"}


def test_eval_set_and_leaderboard(spark):
    df = spark.createDataFrame(
        [(1, [("x", 0, 1, None, "a")], False), (2, [], False), (3, [("x", 0, 1, None, "a")], True), (4, [("x", 0, 1, None, "a")], None)],
        f"sample_id long, entities {ENTITIES_DDL}, is_hard_negative boolean",
    )
    assert sorted(r.sample_id for r in e.eval_set(df).collect()) == [1, 4]
    runs = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-02-01")], "run_id string, created_at string")
    sums = spark.createDataFrame([("a", 0.5, 0.5, 0.5)], "run_id string, macro_precision double, macro_recall double, macro_f1 double")
    board = e.leaderboard(runs, sums, "a").collect()
    assert [(r.run_id, r.status, r.macro_f1) for r in board] == [("b", "inactive", None), ("a", "active", 0.5)]


TEXT = "My name is John Doe and my email is john@doe.com."
SPANS = [("person", 11, 19, None, "John Doe"), ("email address", 36, 48, None, "john@doe.com"), ("Membership Card", 0, 2, None, "My")]


def test_tags_vocabulary_weights(spark):
    samples = spark.createDataFrame([(1, TEXT, SPANS)], f"sample_id long, text string, entities {ENTITIES_DDL}")
    base = ["O", "B-LASTNAME", "I-LASTNAME", "B-FIRSTNAME", "I-FIRSTNAME", "B-EMAIL"]
    vocab = tagging.grow_vocab(samples, spark.createDataFrame(list(enumerate(base)), "id int, tag string"))
    tags = {r.id: r.tag for r in vocab.collect()}
    assert [tags[i] for i in range(6, 10)] == ["B-EMAIL_ADDRESS", "I-EMAIL_ADDRESS", "B-MEMBERSHIP_CARD", "I-MEMBERSHIP_CARD"]
    tagged = tagging.bio_tag(samples, vocab).orderBy("pos").collect()
    by = {(r.start, r.token): tags[r.tag_id] for r in tagged}
    assert by[(11, "John")] == "B-LASTNAME" and by[(16, "Doe")] == "I-LASTNAME" and by[(3, "name")] == "O"
    assert by[(36, "john")] == "B-EMAIL_ADDRESS" and by[(40, "@")] == "I-EMAIL_ADDRESS" and by[(0, "My")] == "B-MEMBERSHIP_CARD"
    weights = {r.id: r for r in tagging.class_weights(tagging.bio_tag(samples, vocab), vocab).collect()}
    counts = {}
    for r in tagged:
        counts[r.tag_id] = counts.get(r.tag_id, 0) + 1
    raw = {i: len(tagged) / (len(tags) * counts[i]) if i in counts else 1.0 for i in tags}
    for i in tags:
        assert weights[i].weight == pytest.approx(min(raw[i] / raw[0], 10.0))
    fixed = {r.tag: r.weight for r in tagging.class_weights(tagging.bio_tag(samples, vocab), vocab, "fixed").collect()}
    assert fixed["O"] == 0.1 and fixed["B-EMAIL"] == 1.0


def test_label_listing(spark):
    vocab = spark.createDataFrame([(0, "O"), (1, "B-FIRSTNAME"), (2, "B-CITY"), (111, "B-MEMBERSHIP_CARD"), (112, "I-MEMBERSHIP_CARD")], "id int, tag string")
    got = {r.label: r.is_custom for r in tagging.vocab_labels(vocab, ["saved one"]).collect()}
    assert got == {"person": False, "address": False, "membership card": True, "saved one": True}


def test_curves(spark):
    rows = [("a", 1, 4.0, 0.1), ("a", 3, 1.0, None), ("a", 2, 9.0, 0.3), ("b", 1, 0.0, None), ("b", 2, None, 0.5)]
    got = {r.run_id: r for r in tagging.curve_summary(spark.createDataFrame(rows, "run_id string, step long, loss double, learning_rate double")).collect()}
    assert got["a"].reduction_percent == 75.0 and got["a"].steps == 3 and got["a"].last_loss == 1.0
    assert got["b"].reduction_percent == 0.0 and got["b"].last_learning_rate == 1e-4


def test_tagger_is_trained_tuned_and_used(spark):
    """A small corpus in which the words around a code and the code's shape give the label away."""
    rows = []
    for i in range(60):
        text = f"please use pin PX-{1000 + i} for room {i} today"
        rows.append((i, text, [("pin", 15, 22, None, text[15:22])]))
    samples = spark.createDataFrame(rows, f"sample_id long, text string, entities {ENTITIES_DDL}")
    vocab = spark.createDataFrame([(0, "O"), (1, "B-PIN"), (2, "I-PIN")], "id int, tag string")
    weights = tagging.class_weights(tagging.bio_tag(samples, vocab), vocab)
    train = training.training_rows(samples, vocab, weights).cache()
    model = training.train_tagger(train, max_iter=15)
    found = {r.sample_id: [(e.label, e.start, e.end) for e in r.pred] for r in training.tagger_detect(samples, model, vocab).collect()}
    assert all(found[i] == [("pin", 15, 22)] for i in range(60))
    best, tried = training.tune_tagger(train, regs=[1e-4, 10.0], iters=[10], parallelism=1)
    loss = {settings["regParam"]: value for settings, value in tried}
    assert len(tried) == 2 and loss[1e-4] < loss[10.0]
    assert {r.tag for r in training.tag_texts(samples, best, vocab).collect()} == {"O", "B-PIN", "I-PIN"}


def test_summary_differences(spark):
    rows = [("a", 0.5, 0.25), ("b", 0.75, 0.125), ("c", 1.0, 1.0)]
    sums = spark.createDataFrame(rows, "run_id string, macro_f1 double, accuracy double")
    assert e.compare_summaries(sums, "a", "b", ["macro_f1", "accuracy"]).first() == (0.25, -0.125)
