"""Training, scoring, metrics and registry of the spam model (Spark ML, with a forest of its own)."""

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer, RegexTokenizer,
    StopWordsRemover, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from threadwise import constants as C
from threadwise.functions import patterns as P
from threadwise.functions.labels import SCORES
from threadwise.functions.text import spam_verdict
from threadwise.operators.filters import since_days
from threadwise.operators.forest import Binning, Forest, column_edges, train_forest

UNTRAINED, NO_DATA, TRAINED, ERROR = "untrained", "no_data", "trained", "error"
# Trees grow until their leaves are pure, or to this depth.
FOREST_DEPTH = 30
TOXICITY_TERMS = 1 << 16


def class_weights(labels: DataFrame, label: str = "is_spam") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    per_class = labels.groupBy(label).agg(F.count("*").alias("n"))
    totals = per_class.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return per_class.withColumn("weight", totals["rows"] / (totals["classes"] * F.col("n")))


def _tokenizer(text: str) -> list:
    terms = RegexTokenizer(inputCol=text, outputCol="__all_terms", pattern=P.TERM, gaps=False)
    return [terms, StopWordsRemover(inputCol="__all_terms", outputCol="__terms")]


@dataclass(frozen=True)
class SpamModel:
    """The columns of a text, then the forest over them."""

    features: PipelineModel
    forest: Forest


def train_spam(labels: DataFrame, text: str = "text", label: str = "is_spam", trees: int = C.FOREST_TREES,
               depth: int = FOREST_DEPTH, numeric: list[str] | None = None) -> SpamModel | None:
    """Fit TF-IDF and a balanced random forest on all labels; None without labels.

    The vocabulary comes from CountVectorizer; an element-wise product applies ln((1+n)/(1+df)) + 1. `numeric`
    names columns, such as the text features, to be used beside the terms; scored tables need them as well.
    A row's draws follow from all columns of the labels, so a key among them sets equal texts apart.
    """
    numeric = numeric or []
    rows = labels.select(text, F.col(label).alias("__label"), *numeric, F.xxhash64(*labels.columns).alias("__seed"))
    tokenized = PipelineModel(_tokenizer(text)).transform(rows).drop("__all_terms", text)
    tokenized = tokenized.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = {r["__label"]: r["weight"] for r in class_weights(tokenized, "__label").collect()}
        if not weights.keys() & {False, True}:
            return None
        known = tokenized.filter(F.col("__label").isNotNull())
        count = CountVectorizer(inputCol="__terms", outputCol="__tf", vocabSize=C.MAX_TERMS, minDF=C.MIN_DOC_FREQ)
        # By name, as terms of equal counts come in no fixed order.
        counting = CountVectorizerModel.from_vocabulary(sorted(count.fit(known).vocabulary), "__terms", "__tf")
        counted = counting.transform(known)
        idf = IDF(inputCol="__tf", outputCol="__idf").fit(counted).idf.toArray() + 1.0
        weighing = ElementwiseProduct(inputCol="__tf", outputCol="__weighted", scalingVec=Vectors.dense(idf))
        norm = Normalizer(inputCol="__weighted", outputCol="__normed")
        join = VectorAssembler(inputCols=["__normed", *numeric], outputCol="__features")
        featured = join.transform(norm.transform(weighing.transform(counted)))
        forest = train_forest(
            featured.select(F.col("__features").alias("x"), F.col("__label").cast("int").alias("y"), F.col("__seed").alias("seed")),
            Binning(len(counting.vocabulary), column_edges(known, numeric)),
            (weights.get(False, 1.0), weights.get(True, 1.0)), trees, depth, C.FOREST_MIN_LEAF, C.FOREST_SEED)
        return SpamModel(PipelineModel([*_tokenizer(text), counting, weighing, norm, join]), forest)
    finally:
        tokenized.unpersist()


def spam_probability(df: DataFrame, model: SpamModel | None, name: str = "p") -> DataFrame:
    """Add the probability of the spam class; NULL without a model."""
    if model is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    scored = model.features.transform(df)
    return scored.withColumn(name, model.forest.probability(F.col("__features"))).select(*df.columns, name)


def score_spam(df: DataFrame, model: SpamModel | None, text: str = "text") -> DataFrame:
    """Score texts with the model and apply the decision policy."""
    return spam_verdict(spam_probability(df, model, "__p"), "__p", text).drop("__p")


def feature_importance(spark: SparkSession, model: SpamModel, k: int = C.TOP_FEATURES_MODEL) -> DataFrame:
    """The k terms (or numeric columns) of highest importance. A vocabulary has at most MAX_TERMS terms."""
    counting, join = model.features.stages[2], model.features.stages[-1]
    names = [*counting.vocabulary, *join.getInputCols()[1:]]
    rows = zip(names, map(float, model.forest.importances))
    ranked = spark.createDataFrame(list(rows), "term STRING, importance DOUBLE")
    return ranked.orderBy(F.desc("importance"), "term").limit(k)


def accuracy(predictions: DataFrame, label: str = "is_spam", prediction: str = "prediction",
             by: list[str] | None = None) -> DataFrame:
    """Share of right predictions among the labelled rows."""
    right = F.count_if(F.col(label) == F.col(prediction))
    return predictions.filter(F.col(label).isNotNull()).groupBy(*(by or [])).agg(
        F.count("*").alias("rows"), F.try_divide(right, F.count("*")).alias("accuracy")
    )


def classification_scores(predictions: DataFrame, label: str = "is_spam", prediction: str = "prediction",
                          by: list[str] | None = None) -> DataFrame:
    """Confusion counts with accuracy, precision, recall and F1, over all predictions or per `by`."""
    y, p = F.col(label), F.col(prediction)
    counts = predictions.filter(y.isNotNull()).groupBy(*(by or [])).agg(
        F.count_if(y & p).alias("true_positive"), F.count_if(~y & p).alias("false_positive"),
        F.count_if(y & ~p).alias("false_negative"), F.count_if(~y & ~p).alias("true_negative"),
    )
    tp, fp, fn, tn = (F.col(c) for c in counts.columns[-4:])
    return counts.withColumns({
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)),
        "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
    })


def spam_metrics(predictions: DataFrame, versions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Model status, training accuracy and sample counts, over all labels or per `by`.

    The status is untrained without a registered spam model, no_data without labels, error where there are labels but the
    registered model gave no prediction for any of them (its folder is damaged or gone), else trained.
    """
    models = versions.filter("model_type = 'spam'").agg(F.count("*")).scalar()
    y = F.col("is_spam")
    counts = predictions.groupBy(*(by or [])).agg(
        F.count(y).alias("total_samples"), F.count_if(y).alias("spam_samples"), F.count_if(~y).alias("ham_samples"),
        F.count_if(y == F.col("prediction")).alias("__right"), F.count("prediction").alias("__predicted"),
    )
    status = F.when(models == 0, UNTRAINED).when(F.col("total_samples") == 0, NO_DATA).when(
        F.col("__predicted") == 0, ERROR).otherwise(TRAINED)
    right = F.try_divide(F.col("__right"), F.col("total_samples"))
    return counts.withColumn("model_status", status).withColumn(
        "train_accuracy", F.when(F.col("model_status") == TRAINED, right)
    ).drop("__right", "__predicted")


def with_split(labels: DataFrame, key: str = "comment_id", share: float = 0.2) -> DataFrame:
    """Add split = training or holdout, by a hash of the key: the same on every run."""
    held = F.pmod(F.xxhash64(key), F.lit(1000)) < int(share * 1000)
    return labels.withColumn("split", F.when(held, "holdout").otherwise("training"))


def register_version(metrics: DataFrame, model_type: str, version: Column, created_at: Column,
                     parameters: dict) -> DataFrame:
    """A model_versions row holding the one-row metrics as JSON."""
    return metrics.select(
        F.lit(model_type).alias("model_type"), version.alias("version"),
        F.to_json(F.struct(*metrics.columns)).alias("metrics"),
        F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"),
        created_at.cast("timestamp_ntz").alias("created_at"),
    )


def metrics_row(version: DataFrame) -> DataFrame:
    """The model_metrics row of a version row."""
    return version.select("model_type", "metrics", "created_at")


def metrics_history(metrics: DataFrame, schema: str, model_type: str = "spam", days: int = C.HISTORY_DAYS,
                    as_of: Column | None = None) -> DataFrame:
    """Decoded metrics of the last days, oldest first."""
    recent = since_days(metrics.filter(F.col("model_type") == model_type), "created_at", days, as_of)
    decoded = recent.select("created_at", F.from_json("metrics", schema).alias("m"))
    return decoded.select("created_at", "m.*").orderBy("created_at")


def save_model(model: SpamModel, path: str) -> str:
    """Write a model to a new folder; the registry names it only after the write has succeeded."""
    model.features.write().save(f"{path}/features")
    model.forest.save(f"{path}/forest")
    return path


def load_model(paths: list[str]) -> SpamModel | None:
    """The first loadable spam model of the paths, newest first; None means untrained."""
    for path in paths:
        try:
            return SpamModel(PipelineModel.load(f"{path}/features"), Forest.load(SparkSession.active(), f"{path}/forest"))
        except Exception:
            # A missing or damaged model folder falls back to the version before it.
            continue
    return None


# A scorer gets texts and returns one score dictionary per text; its maker runs once per task.
ScorerMaker = Callable[[], Callable[[pd.Series], pd.Series]]


def apply_scorer(df: DataFrame, maker: ScorerMaker, text: str = "text", name: str = "toxicity_scores") -> DataFrame:
    """Add a map of label scores from a user scorer, batch by batch; a text whose scoring fails has no map."""

    @F.pandas_udf(SCORES)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = maker()

        def one(text: str) -> dict | None:
            try:
                return scorer(pd.Series([text])).iloc[0]
            except Exception:  # whatever the user's model raises costs this text only
                return None

        for part in parts:
            try:
                yield scorer(part)
            except Exception:
                yield part.map(one)

    return df.withColumn(name, score(F.col(text)))


@dataclass(frozen=True)
class ToxicityModel:
    """Logistic regression over hashed terms: the scorer used where no pretrained classifier is at hand."""

    pipeline: PipelineModel

    @classmethod
    def train(cls, labels: DataFrame, text: str = "text", label: str = "toxic") -> "ToxicityModel":
        stages = [*_tokenizer(text), HashingTF(inputCol="__terms", outputCol="__features", numFeatures=TOXICITY_TERMS)]
        rows = labels.select(text, F.col(label).cast("double").alias("__label"))
        features = PipelineModel(stages).transform(rows).select("__label", "__features").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            regression = LogisticRegression(
                labelCol="__label", featuresCol="__features", regParam=0.01, maxIter=20,
                rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__prediction",
            )
            return cls(PipelineModel([*stages, regression.fit(features)]))
        finally:
            features.unpersist()

    def score(self, df: DataFrame, name: str = "toxicity_scores") -> DataFrame:
        scored = self.pipeline.transform(df)
        probability = F.get(vector_to_array("__probability"), F.lit(1))
        return scored.withColumn(name, F.create_map(F.lit("toxic"), probability)).select(*df.columns, name)


def score_entries(scores: Column) -> Column:
    """A score map as the (label, score) list of the toxicity summary, in label order."""
    fields = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))
    return F.array_sort(F.map_entries(scores)).cast(fields)
