"""A token tagger trained on tagged samples, and its use as a detector.

The reference work fine-tunes a transformer on one machine; here a multinomial logistic
regression over hashed token features is fitted by all executors.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import pii
from ..functions.spans import NO_ENTITIES
from .detect import canonical_sql
from .tagging import IGNORED, bio_tag, tokens_of

FEATURES = 1 << 14

_SHAPE = "regexp_replace(regexp_replace(regexp_replace({0}, '[a-z]+', 'a'), '[A-Z]+', 'A'), '[0-9]', '0')"


def features_sql() -> str:
    """Per token: itself, its shape and ends, and its neighbours."""
    at = {"prev": "get(ws, i - 1)", "here": "w", "next": "get(ws, i + 1)"}
    names = [f"concat('{k}=', coalesce(lower({v}), ''))" for k, v in at.items()]
    names += [f"concat('{k}_shape=', coalesce({_SHAPE.format(v)}, ''))" for k, v in at.items()]
    names += ["concat('head=', substring(w, 1, 3))", "concat('tail=', substring(w, -3, 3))"]
    return f"get(transform(array(transform(_t, t -> t.value)), ws -> transform(ws, (w, i) -> array({', '.join(names)}))), 0)"


def training_rows(samples: DataFrame, vocab: DataFrame, weights: DataFrame, custom: list[str] = ()) -> DataFrame:
    """Tokens with features, class and class weight (a table as small as the vocabulary)."""
    rows = bio_tag(samples, vocab, custom, features_sql()).filter(F.col("tag_id") != IGNORED).drop("label")
    return rows.join(weights.select(F.col("id").alias("tag_id"), "weight"), "tag_id").withColumn(
        "label", F.col("tag_id").cast("double")
    )


def _stages(max_iter: int, reg: float):
    hashed = HashingTF(inputCol="features", outputCol="hashed", numFeatures=FEATURES, binary=True)
    model = LogisticRegression(
        featuresCol="hashed", labelCol="label", weightCol="weight", family="multinomial", maxIter=max_iter, regParam=reg
    )
    return hashed, model


def train_tagger(rows: DataFrame, max_iter: int = 20, reg: float = 1e-4) -> PipelineModel:
    return Pipeline(stages=list(_stages(max_iter, reg))).fit(rows)


def tune_tagger(
    rows: DataFrame, regs: list[float] = (1e-5, 1e-3), nets: list[float] = (0.0,), iters: list[int] = (10, 20),
    parallelism: int = 2, seed: int = 17,
) -> tuple[PipelineModel, list[tuple[dict, float]]]:
    """Best model of the grid by evaluation loss, and the loss of every setting."""
    hashed, model = _stages(20, 1e-4)
    grid = (
        ParamGridBuilder().addGrid(model.regParam, list(regs)).addGrid(model.elasticNetParam, list(nets))
        .addGrid(model.maxIter, list(iters)).build()
    )
    loss = MulticlassClassificationEvaluator(metricName="logLoss", labelCol="label", weightCol="weight")
    search = TrainValidationSplit(
        estimator=Pipeline(stages=[hashed, model]), estimatorParamMaps=grid, evaluator=loss,
        trainRatio=0.8, parallelism=parallelism, seed=seed,
    )
    fitted = search.fit(rows)
    tried = [({p.name: v for p, v in g.items()}, m) for g, m in zip(grid, fitted.validationMetrics)]
    return fitted.bestModel, tried


def tag_texts(samples: DataFrame, model: PipelineModel, vocab: DataFrame) -> DataFrame:
    """Tokens with the predicted tag and its probability."""
    tokens = tokens_of(samples, "sample_id", features=features_sql()).select(
        "sample_id", "pos", "t.start", "t.end", F.col("t.value").alias("token"), F.col("f").alias("features")
    )
    scored = model.transform(tokens)
    tags = vocab.select(F.col("id").cast("double").alias("prediction"), "tag")
    return scored.withColumn("score", F.array_max(vector_to_array("probability"))).join(tags, "prediction", "left").select(
        "sample_id", "pos", "start", "end", "token", "tag", "score"
    )


def tagger_detect(
    samples: DataFrame, model: PipelineModel, vocab: DataFrame, threshold: float = pii.DEFAULT_THRESHOLD,
    custom: list[str] = (),
) -> DataFrame:
    """Samples with pred: neighbouring tokens of one label form a span with their mean score.

    A B- tag always opens a span. Only the tagged tokens of a text are regrouped.
    """
    tagged = tag_texts(samples, model, vocab).filter(F.col("tag") != "O")
    spans = f"""transform(aggregate(_t, cast(array() as array<struct<label:string,start:int,end:int,pos:int,score:double,n:int>>), (acc, t) ->
        CASE WHEN size(acc) > 0 AND try_element_at(acc, -1).label = substring(t.tag, 3) AND t.tag NOT LIKE 'B-%' AND try_element_at(acc, -1).pos = t.pos - 1
             THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('label', substring(t.tag, 3), 'start', try_element_at(acc, -1).start, 'end', t.end,
                  'pos', t.pos, 'score', try_element_at(acc, -1).score + t.score, 'n', try_element_at(acc, -1).n + 1)))
             ELSE concat(acc, array(named_struct('label', substring(t.tag, 3), 'start', t.start, 'end', t.end, 'pos', t.pos, 'score', t.score, 'n', 1))) END),
        s -> named_struct('label', {canonical_sql('s.label', custom)}, 'start', s.start, 'end', s.end, 'score', s.score / s.n, 'value', substring(text, s.start + 1, s.end - s.start)))"""
    grouped = tagged.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("pos", "start", "end", "tag", "score"))).alias("_t"))
    rows = samples.join(grouped, "sample_id", "left")
    found = F.when(F.col("_t").isNull(), F.expr(NO_ENTITIES)).otherwise(F.expr(spans))
    rows = rows.withColumn("pred", found).drop("_t")
    return rows.withColumn("pred", F.filter("pred", lambda e: e["score"] >= threshold))
