"""Queries: TF-IDF, training, scoring, metrics, registry and label feedback (section 2.9 of the survey)."""

from functools import cache

from pyspark.sql import functions as F

from threadwise import constants as C
from threadwise.operators import feedback, learning, multilabel
from threadwise.operators.tfidf import tfidf as tfidf_weights
from threadwise.plans.catalog import query
from threadwise.plans.oracle_text import sql_list
from threadwise.plans.views import Tables
from threadwise.session import scratch_dir
from threadwise.sources.tables import append_rows, scan_table
from threadwise.schemas import MODEL_METRICS, MODEL_VERSIONS

AS_OF = "2024-02-01 00:00:00"
PARAMETERS = {"depth": learning.FOREST_DEPTH, "seed": C.FOREST_SEED, "trees": C.FOREST_TREES}


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _labels(q):
    return feedback.latest_label(q("spam_training")).select("comment_id", "text", "is_spam")


@cache
def _model(q: Tables):
    """The spam model of a folder, trained once per session."""
    return learning.train_spam(_labels(q))


@query(["comments_doc"], rf"""
with terms as (
  select comment_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'),
                            lambda w: length(w) > 1 and w not in ({sql_list(C.ENGLISH_STOP_WORDS)}))) as term from comments_doc),
tf as (select comment_id, term, count(*) as tf from terms group by all),
vocabulary as (
  select term, count(*) as df, sum(tf) as total from tf group by term having count(*) >= 2
  order by total desc, term limit 1000),
weighted as (
  select comment_id, term, tf,
         tf * (ln(((select count(*) from comments_doc) + 1) / cast(df + 1 as double)) + 1) as w
  from tf join vocabulary using (term))
select comment_id, term, tf, round(w / sqrt(sum(w * w) over (partition by comment_id)), 6) as weight from weighted""")
def tfidf(q):
    weights = tfidf_weights(q("comments_doc"), "comment_id")
    return weights.withColumn("weight", F.round("weight", 6))


@query(["spam_training"], """
with counts as (select is_spam, count(*) as n from spam_training group by is_spam)
select is_spam, n, (select sum(n) from counts) / ((select count(*) from counts) * cast(n as double)) as weight from counts""")
def class_weights(q):
    return learning.class_weights(q("spam_training"))


@query()
def train_spam(q):
    """Training and hold-out scores of a model that has not seen the hold-out labels."""
    labels = learning.with_split(_labels(q))
    model = learning.train_spam(labels.filter("split = 'training'"))
    predicted = learning.spam_probability(labels, model).withColumn("prediction", F.col("p") > 0.5)
    return learning.classification_scores(predicted, by=["split"])


@query()
def score_spam(q):
    return learning.score_spam(q("comments_doc").select("comment_id", "text"), _model(q)).drop("text")


@query()
def feature_importance(q):
    return learning.feature_importance(q.spark, _model(q), C.TOP_FEATURES_VIDEO)


def _predictions(q):
    """Fixture predictions: p > 0.5 beside the label."""
    scores = q("model_scores").select("comment_id", (F.col("p") > 0.5).alias("prediction"))
    return q("comments_doc").select("comment_id", "video_id", "is_spam").join(scores, "comment_id")


PREDICTED = """
predicted as (
  select video_id, is_spam, p > cast(0.5 as double) as prediction
  from comments_doc join model_scores using (comment_id))"""
PREDICTED_VIEWS = ["comments_doc", "model_scores"]


@query(PREDICTED_VIEWS, f"""
with {PREDICTED}
select count(*) as rows, avg(cast(is_spam = prediction as integer)) as accuracy from predicted where is_spam is not null""")
def model_accuracy(q):
    return learning.accuracy(_predictions(q))


@query(PREDICTED_VIEWS, f"""
with {PREDICTED},
counts as (
  select count(case when is_spam and prediction then 1 end) as true_positive,
         count(case when not is_spam and prediction then 1 end) as false_positive,
         count(case when is_spam and not prediction then 1 end) as false_negative,
         count(case when not is_spam and not prediction then 1 end) as true_negative
  from predicted where is_spam is not null)
select *, (true_positive + true_negative) / cast(true_positive + false_positive + false_negative + true_negative as double) as accuracy,
       coalesce(true_positive / cast(nullif(true_positive + false_positive, 0) as double), 0) as precision,
       coalesce(true_positive / cast(nullif(true_positive + false_negative, 0) as double), 0) as recall,
       coalesce(2 * true_positive / cast(nullif(2 * true_positive + false_positive + false_negative, 0) as double), 0) as f1
from counts""")
def classification_scores(q):
    return learning.classification_scores(_predictions(q))


METRICS_SQL = """
select {key}count(is_spam) as total_samples, count(case when is_spam then 1 end) as spam_samples,
       count(case when not is_spam then 1 end) as ham_samples,
       case when (select count(*) from model_versions where model_type = 'spam') = 0 then 'untrained'
            when count(is_spam) = 0 then 'no_data' else 'trained' end as model_status,
       count(case when is_spam = prediction then 1 end) / cast(nullif(count(is_spam), 0) as double) as train_accuracy
from predicted {group}"""


@query([*PREDICTED_VIEWS, "model_versions"], f"with {PREDICTED} {METRICS_SQL.format(key='', group='')}")
def spam_metrics(q):
    return learning.spam_metrics(_predictions(q), q("model_versions"))


@query([*PREDICTED_VIEWS, "model_versions"],
       f"with {PREDICTED} {METRICS_SQL.format(key='video_id, ', group='group by video_id')}")
def spam_metrics_by_video(q):
    return learning.spam_metrics(_predictions(q), q("model_versions"), ["video_id"])


@query()
def model_metrics(q):
    """Metrics of the trained model with its top terms, as the service reports them."""
    model = _model(q)
    predicted = learning.spam_probability(_labels(q), model).withColumn("prediction", F.col("p") > 0.5)
    metrics = learning.spam_metrics(predicted, q("model_versions"))
    top = learning.feature_importance(q.spark, model).agg(F.map_from_entries(
        F.collect_list(F.struct("term", "importance")))).scalar()
    return metrics.withColumn("top_features", top)


@query(["spam_training", "model_versions"], """
select model_type, version, metrics, parameters, created_at from model_versions
union all
select 'spam', 'v' || cast(epoch(max(labeled_at)) as bigint),
       '{"total_samples":' || count(*) || ',"spam_samples":' || count(case when is_spam then 1 end)
       || ',"ham_samples":' || count(case when not is_spam then 1 end) || '}',
       '{"depth": 30, "seed": 42, "trees": 100}', timestamp '2024-02-01 00:00:00' from spam_training""")
def register_version(q):
    """The registry after a training run has appended its version and its metrics."""
    from threadwise.functions.times import seconds_between
    from threadwise.operators.statistics import training_counts

    folder = scratch_dir(q.spark, "registry")
    labels = q("spam_training")
    newest = labels.agg(F.max("labeled_at")).scalar()
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    version = F.concat(F.lit("v"), F.floor(seconds_between(epoch, newest)).cast("string"))
    row = learning.register_version(training_counts(labels), "spam", version, as_of(), PARAMETERS)
    append_rows(q("model_versions"), f"{folder}/model_versions")
    append_rows(row, f"{folder}/model_versions")
    append_rows(learning.metrics_row(row), f"{folder}/model_metrics")
    assert scan_table(q.spark, f"{folder}/model_metrics", MODEL_METRICS).count() == 1
    return scan_table(q.spark, f"{folder}/model_versions", MODEL_VERSIONS)


@query()
def save_load_model(q):
    """Scores of the model after it has been written and read back; a damaged newer version is passed over."""
    folder = scratch_dir(q.spark, "models")
    path = learning.save_model(_model(q), f"{folder}/v1")
    loaded = learning.load_model([f"{folder}/v2", path])
    return learning.score_spam(q("comments_doc").select("comment_id", "text"), loaded).drop("text")


@query(["model_versions"], """
select created_at, cast(metrics->>'accuracy' as double) as accuracy, cast(metrics->>'total_samples' as bigint) as total_samples
from model_versions where model_type = 'spam' and created_at >= timestamp '2024-02-01 00:00:00' - interval 30 day
order by created_at""")
def metrics_history(q):
    metrics = learning.metrics_row(q("model_versions"))
    return learning.metrics_history(metrics, "accuracy DOUBLE, total_samples BIGINT", as_of=as_of())


@query(["model_versions"], """
select model_type, created_at, metrics from model_versions
where created_at >= (select max(created_at) from model_versions) - interval 30 day order by created_at""")
def recent_metrics(q):
    from threadwise.operators.filters import since_days

    return since_days(learning.metrics_row(q("model_versions")), "created_at").orderBy("created_at")


@query(["comments_ev", "label_requests"], """
select r.request_id, r.comment_id, r.is_spam, r.requested_at,
       case when r.is_spam is null then 'label is not boolean' when c.comment_id is null then 'comment not found' end as error,
       case when r.is_spam is null or c.comment_id is null then 'error' else 'success' end as status
from label_requests r left join comments_ev c on r.comment_id = c.comment_id""")
def mark_spam(q):
    return feedback.mark_spam(q("label_requests"), q("comments_ev")).outcomes


@query(["comments_doc", "label_requests"], """
select r.comment_id, c.text, r.is_spam, cast(1 as double) as confidence, r.requested_at as labeled_at,
       cast(null as timestamp) as trained_at
from label_requests r join comments_doc c on r.comment_id = c.comment_id where r.is_spam is not null""")
def mark_spam_labels(q):
    return feedback.mark_spam(q("label_requests"), q("comments_doc")).labels


@query(["comments_ev", "label_requests"], """
with accepted as (
  select r.* from label_requests r join comments_ev c on r.comment_id = c.comment_id where r.is_spam is not null
  qualify row_number() over (partition by r.comment_id order by requested_at desc, request_id desc) = 1)
select c.comment_id, coalesce(a.is_spam, c.is_spam) as is_spam, coalesce(cast(a.is_spam as double), c.spam_score) as spam_score,
       a.requested_at as updated_at
from comments_ev c left join accepted a on c.comment_id = a.comment_id""")
def mark_spam_comments(q):
    return feedback.mark_spam(q("label_requests"), q("comments_ev")).comments.select(
        "comment_id", "is_spam", "spam_score", "updated_at")


BULK = """
sets as (
  select r.request_id, r.is_spam, count(*) as total, count(case when c.comment_id is null then 1 end) as missing
  from (select distinct request_id, is_spam, comment_id from label_requests) r
  left join comments_ev c on r.comment_id = c.comment_id group by r.request_id, r.is_spam),
outcomes as (
  select *, case when is_spam is null then 'label is not boolean' when missing > 0 then 'comment not found' end as error from sets)"""


@query(["comments_ev", "label_requests"], f"""
with {BULK}
select *, case when error is null then 'success' else 'error' end as status,
       case when error is null then total else 0 end as processed from outcomes""")
def mark_spam_bulk(q):
    return feedback.mark_spam_bulk(q("label_requests"), q("comments_ev")).outcomes


@query(["comments_ev", "label_requests"], f"""
with {BULK},
accepted as (
  select r.comment_id, r.is_spam, r.requested_at, r.request_id from label_requests r
  join outcomes o on r.request_id = o.request_id and r.is_spam = o.is_spam where o.error is null
  qualify row_number() over (partition by r.comment_id order by r.requested_at desc, r.request_id desc) = 1)
select c.comment_id, coalesce(a.is_spam, c.is_spam) as is_spam, a.requested_at as updated_at
from comments_ev c left join accepted a on c.comment_id = a.comment_id""")
def mark_spam_bulk_comments(q):
    return feedback.mark_spam_bulk(q("label_requests"), q("comments_ev")).comments.select(
        "comment_id", "is_spam", "updated_at")


@query(["spam_training", "model_versions"], """
with counted as (
  select count(case when trained_at is null then 1 end) as untrained_labels,
         count(case when labeled_at > (select max(created_at) from model_versions where model_type = 'spam') then 1 end) as newer_labels
  from spam_training)
select *, untrained_labels >= 10 as due_by_untrained, newer_labels >= 10 as due_by_newer from counted""")
def retrain_due(q):
    return feedback.retrain_due(q("spam_training"), q("model_versions"))


@query(["spam_training"], """
select comment_id, seq, coalesce(trained_at, timestamp '2024-02-01 00:00:00') as trained_at from spam_training""")
def mark_trained(q):
    return feedback.mark_trained(q("spam_training"), as_of()).select("comment_id", "seq", "trained_at")


@query()
def score_toxicity(q):
    """Toxicity scores of all texts by the model trained on the toxic labels, with the summary columns."""
    from threadwise.functions.labels import toxicity_summary

    judged = q.raw("documents").join(q.raw("labels"), "doc_id").select("text", "toxic")
    scored = learning.ToxicityModel.train(judged).score(q("comments_doc").select("comment_id", "text"))
    listed = scored.withColumn("toxicity", learning.score_entries(F.col("toxicity_scores")))
    return toxicity_summary(listed).select("comment_id", "main_category", "toxicity_score")


@query()
def score_labels(q):
    """Three labels of every whole text by one scorer, fitted in common on the judged texts and run through the scorer
    hook: toxic, of low quality, and neither."""
    judged = q.raw("documents").join(q.raw("labels"), "doc_id").select(
        "text", (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 0).alias("poor"),
        ((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("fine"))
    scorer = multilabel.train_labels(judged, ["toxic", "poor", "fine"])
    scored = learning.apply_scorer(q("comments_doc").select("comment_id", "text"), scorer.maker())
    return scored.select("comment_id", F.explode(learning.score_entries(F.col("toxicity_scores"))).alias("e")).select(
        "comment_id", "e.label", "e.score")
