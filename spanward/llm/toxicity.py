"""Toxicity of texts by a weighted finite-state grammar over clauses.

Five small transducers read the words of a clause together: insults, threats, targets, negation and reported speech.
Their product says in which context each insult stands: threatened, reported, negated, aimed at someone, or plain.
A text is scored by the summed weights per context, not by single words, and a logistic function whose coefficients,
one per context, are fitted to the labels; a negated or reported insult counts as much as the labels say it does.

The insult lexicon is learned too: words, and stems with any longer ending, that labelled toxic texts hold much more
often than others. Both are fitted on a bounded sample, ``SAMPLE`` labelled rows in the order of a hash of their id;
copies of a text teach once. While fitting, a text is scored by counts without itself.

Defined cases: null and empty texts get the score of a text without matches; rows without a label, or with one other
than 0 and 1, teach nothing; with no label of either kind all scores are the prior; repeated rows are scored alike;
null ids count as not held out; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from .arrow import row_slices
from .language import held_out

#: Labelled rows that lexicon and coefficients are fitted on, at most.
SAMPLE = 24_000
#: Lengths of stems, in letters.
STEMS = range(4, 9)
#: An entry needs so many toxic texts, and to be so many times as frequent in them as in others.
SUPPORT = 4
RATIO = 8.0
THRESHOLD = 0.3
#: Words after a negation that it reaches.
NEGATION_REACH = 3

# Closed word classes of four languages.
TARGETS = frozenset("you your he she they them we him her du dich ihr euch sie er tu toi vous il elle ils tú te usted ustedes él ella ellos".split())
THREATS = frozenset("kill hurt beat destroy shoot stab töten schlagen umbringen tuer frapper détruire matar golpear destruir".split())
NEGATIONS = frozenset("not no never neither nor nicht kein keine nie ne pas jamais ni nunca jamás".split())
REPORTS = frozenset("said says called quoted reported claims sagte sagt nannte berichtete dit disait appelle dijo dice llamó".split())

CONTEXTS = ("threat", "reported", "negated", "targeted", "plain")
_WORDS = re.compile(r"[^\W\d_]+|[.!?;:,\n]")
_ENDS = frozenset(".!?;:,\n")


@dataclass(frozen=True)
class Lexicon:
    """Counts of toxic and other texts by word and by stem, and of all texts taught."""

    words: dict[str, tuple[int, int]]
    stems: dict[str, tuple[int, int]]
    toxic: int
    other: int

    def weight(self, counts: tuple[int, int], own: int | None = None) -> float:
        """Log of how many times as frequent, 0 below ``RATIO``; ``own`` is the label of a text to leave out."""
        a, b = counts
        a, b = a - (own == 1), b - (own == 0)
        if a < SUPPORT - (own == 1):
            return 0.0
        ratio = ((a + 0.5) / (self.toxic + 1)) / ((b + 0.5) / (self.other + 1))
        return math.log(ratio) if ratio >= RATIO else 0.0

    def find(self, word: str) -> tuple[int, int] | None:
        """Counts of a word, or of its longest stem that is an entry."""
        if word in self.words:
            return self.words[word]
        for n in range(min(STEMS.stop, len(word)) - 1, STEMS.start - 1, -1):
            if word[:n] in self.stems:
                return self.stems[word[:n]]
        return None


def _entries(text: str) -> tuple[set[str], set[str]]:
    words = {w for w in _WORDS.findall(text.lower()) if w not in _ENDS}
    return words, {w[:n] for w in words for n in STEMS if n < len(w)}


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counter()
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, stems = _entries(text or "")
            counts.update(("w", w, toxic) for w in words)
            counts.update(("s", s, toxic) for s in stems)
        if len(counts) > 1_000_000:
            yield _count_rows(counts)
            counts = Counter()
    yield _count_rows(counts)


def _count_rows(counts: Counter) -> pa.RecordBatch:
    kind, entry, toxic = zip(*counts) if counts else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.string()), pa.array(entry, pa.string()), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64())],
        ["kind", "entry", "toxic", "n"],
    )


def learn_lexicon(taught: DataFrame) -> Lexicon:
    """From rows (toxic, text). A word or stem is kept if it is an entry or overrides the stem it begins with."""
    counts = taught.mapInArrow(_teach, "kind string, entry string, toxic int, n bigint")
    both = counts.groupBy("kind", "entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    both = materialise(both.where(f"a >= {SUPPORT} OR b >= {SUPPORT}"), "lexicon")
    total = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    toxic, other = total.get(1, 0), total.get(0, 0)
    strong = f"a >= {SUPPORT} AND ((a + 0.5) / {toxic + 1}) / ((b + 0.5) / {other + 1}) >= {RATIO}"
    stems = {r["entry"]: (r["a"], r["b"]) for r in both.where("kind = 's'").where(strong).collect()}
    words = {r["entry"]: (r["a"], r["b"]) for r in both.where("kind = 'w'").where(strong).collect()}
    # words that are frequent without being toxic and begin with a stem keep their own, lower weight
    begin = F.array(*[F.substring("entry", 1, n) for n in STEMS])
    tame = both.where("kind = 'w'").where(f"NOT ({strong})").where(F.arrays_overlap(begin, F.array(*[F.lit(s) for s in stems]))) if stems else None
    if tame is not None:
        words.update({r["entry"]: (r["a"], r["b"]) for r in tame.collect()})
    return Lexicon(words, stems, toxic, other)


def _context(threat: bool, reported: bool, negated: bool, targeted: bool) -> int:
    if threat and targeted:
        return 0
    return 1 if reported else 2 if negated else 3 if targeted else 4


class Grammar:
    """The product of the five transducers, reading one word at a time."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: dict[str, tuple] = {}

    def kind(self, word: str) -> tuple:
        """(counts of an insult or None, threat, target, negation, report) of a word."""
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = (self.lexicon.find(word), word in THREATS, word in TARGETS, word in NEGATIONS, word in REPORTS)
        return self.known[word]

    def sums(self, text: str, own: int | None = None) -> list[float]:
        """Weights per context over all clauses, and the number of words."""
        out, words = [0.0] * len(CONTEXTS), 0
        insults: list[tuple[float, bool]] = []
        threat = reported = targeted = False
        reach = 0
        for word in _WORDS.findall(text.lower()):
            if word in _ENDS:
                if insults or (threat and targeted):
                    for weight, negated in insults or [(1.0, False)]:
                        out[_context(threat, reported, negated, targeted)] += weight
                insults, threat, reported, targeted, reach = [], False, False, False, 0
                continue
            words += 1
            counts, is_threat, is_target, is_negation, is_report = self.kind(word)
            if counts is not None:
                weight = self.lexicon.weight(counts, own)
                if weight:
                    insults.append((weight, reach > 0))
            threat, targeted, reported = threat or is_threat, targeted or is_target, reported or is_report
            reach = NEGATION_REACH if is_negation else reach - (reach > 0)
        for weight, negated in insults or ([(1.0, False)] if threat and targeted else []):
            out[_context(threat, reported, negated, targeted)] += weight
        return [*out, float(words)]


def features(sums: np.ndarray) -> np.ndarray:
    """Per context, the log of the summed weights; of all, also per thousand words; a constant."""
    by_context, words = sums[:, :-1], sums[:, -1:]
    total = by_context.sum(axis=1, keepdims=True)
    return np.hstack([np.log1p(by_context), np.log1p(total), np.log1p(1000 * total / np.maximum(words, 20)), np.ones_like(total)])


def _sums(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            labels = batch.column(0).to_pylist()
            rows = [grammar.sums(t or "", y) for y, t in zip(labels, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "sums"])

    return run


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: tuple[float, ...]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    ship(docs.sparkSession)
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    some = some.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    once = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.struct("toxic", "text")).alias("r")).select("r.toxic", "r.text")
    taught = materialise(once, "taught").repartition(16, F.xxhash64("text"))
    lexicon = learn_lexicon(taught)
    rows = taught.mapInArrow(_sums(lexicon), "toxic int, sums array<double>").collect()
    if not lexicon.toxic or not lexicon.other:
        prior = math.log((lexicon.toxic + 0.5) / (lexicon.other + 0.5))
        return Model(lexicon, (*[0.0] * (len(CONTEXTS) + 2), prior))
    x = features(np.array([r["sums"] for r in rows]))
    return Model(lexicon, tuple(fit(x, np.array([r["toxic"] for r in rows], float))))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, w = Grammar(model.lexicon), np.array(model.coefficients)
        for batch in row_slices(batches, "text"):
            sums = np.array([grammar.sums(t or "") for t in batch.column(2).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(features(sums) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score) of every text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), "doc_id bigint, held_out boolean, score double")


def _keep(model: Model, threshold: float, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, w = Grammar(model.lexicon), np.array(model.coefficients)
        for batch in batches:
            sums = np.array([grammar.sums(t or "") for t in batch.column(place).to_pylist()]).reshape(-1, len(CONTEXTS) + 1)
            p = 1 / (1 + np.exp(-np.clip(features(sums) @ w, -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return run


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that score ``threshold`` or more."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_keep(model, threshold, docs.columns.index(text_col)), docs.schema)
