"""Queries: the streaming jobs over the test tables (section 2.11 of the survey)."""

from pyspark.sql import functions as F

from threadwise.operators import feedback
from threadwise.plans import analyze
from threadwise.plans.catalog import query
from threadwise.plans.queries_text import ANALYZED_SQL, _toxicity
from threadwise.session import scratch_dir
from threadwise.streaming import counters, jobs


def _read(q, stream, name):
    return q.spark.read.parquet(jobs.run_to_files(stream, scratch_dir(q.spark, name)))


def _plain(df, *columns):
    """Event times back to zone-free timestamps."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(["comments_ev"], "select comment_id, video_id, author, timestamp from comments_ev")
def stream_ingest(q):
    """Every comment arrives twice and is kept once."""
    comments = q("comments_ev", streamed="events").select("comment_id", "video_id", "author", "timestamp")
    stored = jobs.ingest(comments.union(comments), scratch_dir(q.spark, "ingest"))
    return q.spark.read.parquet(stored).drop("batch")


@query(["comments_ev"], """
select cast(timestamp as date) as day, count(*) as total, count(case when is_spam then 1 end) as spam,
       count(case when is_spam then 1 end) / cast(count(*) as double) as ratio
from comments_ev group by cast(timestamp as date)
having cast(timestamp as date) + interval 1 day <= (select max(timestamp) from comments_ev) - interval 1 day""")
def stream_trends(q):
    return _read(q, jobs.daily_trends(q("comments_ev", streamed="events")), "trends")


@query(["comments_ev"], """
with marked as (
  select video_id, timestamp, coalesce(timestamp - lag(timestamp) over w >= interval 30 minute, true) as opens
  from comments_ev window w as (partition by video_id order by timestamp)),
numbered as (
  select *, sum(cast(opens as integer)) over (partition by video_id order by timestamp) as s from marked)
select video_id, min(timestamp) as session_start, max(timestamp) + interval 30 minute as session_end, count(*) as n
from numbered group by video_id, s
having max(timestamp) + interval 30 minute <= (select max(timestamp) from comments_ev) - interval 10 minute""")
def stream_sessions(q):
    bursts = _read(q, jobs.sessions(q("comments_ev", streamed="events")), "sessions")
    return _plain(bursts, "session_start", "session_end")


@query(["comments_ev"], """
select video_id, window_start, window_start + interval 1 hour as window_end, count(*) as n
from (select video_id, time_bucket(interval 15 minute, timestamp) - to_minutes(cast(15 * unnest([0, 1, 2, 3]) as integer)) as window_start
      from comments_ev)
group by video_id, window_start
having window_start + interval 1 hour <= (select max(timestamp) from comments_ev) - interval 10 minute""")
def stream_sliding(q):
    counts = _read(q, jobs.sliding_counts(q("comments_ev", streamed="events")), "sliding")
    return _plain(counts, "window_start", "window_end")


@query(["comments_doc", "model_scores"], f"""
with {ANALYZED_SQL}
select comment_id, toxicity_score, spam_score, is_spam, sentiment, content_class || ':' || sentiment as classification
from analyzed""")
def stream_analyze(q):
    """New texts are scored as they arrive; the model columns come from a static table."""
    arriving = q("comments_doc", streamed="documents")
    scores = _toxicity(q).select("comment_id", "p", "toxicity", "compound")

    def write(batch, path):
        results = analyze.analyze_queue(batch.join(scores, "comment_id"))
        results.select("comment_id", "toxicity_score", "spam_score", "is_spam", "sentiment", "classification").write.mode(
            "overwrite").parquet(path)

    folder = jobs.run_batches(arriving, scratch_dir(q.spark, "analyze"), write)
    return q.spark.read.parquet(folder).drop("batch")


@query(["comments_ev"], "select 2 * count(*) as fetched, count(*) as inserted, count(*) as duplicates from comments_ev")
def stream_ingest_counts(q):
    """Rows fetched, inserted and repeated over all micro-batches of `stream_ingest`."""
    comments = q("comments_ev", streamed="events").select("comment_id", "video_id", "author", "timestamp")
    folder = scratch_dir(q.spark, "ingest")
    jobs.ingest(comments.union(comments), folder)
    counts = jobs.ingested_counts(q.spark, folder)
    return counts.agg(*[F.sum(c).alias(c) for c in ("fetched", "inserted", "duplicates")])


@query(["comments_doc", "model_scores"], f"""
with {ANALYZED_SQL}
select c.comment_id, coalesce(a.content_class || ':' || a.sentiment, c.classification) as classification,
       coalesce(a.spam_score, c.spam_score) as spam_score, coalesce(a.toxicity_score, c.toxicity_score) as toxicity_score
from comments_doc c left join analyzed a on c.comment_id = a.comment_id and cast(c.comment_id as bigint) % 10 <> 0""")
def stream_scores(q):
    """Two streams meet: comments, and scores made up to 49 minutes later, a tenth of which never come. The results are
    written back; comments without scores stay in the queue."""
    comments = q("comments_doc", streamed="documents").select("comment_id", "text", "timestamp", "classification", "spam_score")
    number = F.col("comment_id").cast("long")
    scored_at = F.col("timestamp") + F.make_dt_interval(mins=(number % 50).cast("int"))
    streamed = scored_stream(q).filter(number % 10 != 0).withColumn("scored_at", scored_at).drop("timestamp")
    results, _ = jobs.analysis(comments, streamed, scratch_dir(q.spark, "scores"))
    found = q.spark.read.parquet(results).drop("batch")
    return analyze.write_back(q("comments_doc"), found).select("comment_id", "classification", "spam_score", "toxicity_score")


def scored_stream(q):
    """Model columns of the documents as a stream, with the time of their comment."""
    times = q("comments_doc", streamed="documents").select("comment_id", "timestamp")
    number = F.col("comment_id").cast("long")
    share = lambda by: (number * by % 101).cast("double") / 100  # noqa: E731  as in the view model_scores
    entry = lambda name, by: F.struct(F.lit(name).alias("label"), share(by).alias("score"))
    return times.withColumns({
        "p": share(1), "toxicity": F.array(entry("toxic", 37), entry("insult", 53), entry("threat", 71)),
        "compound": (number * 59 % 201).cast("double") / 100 - 1})


def _feedback(q):
    """The feedback job over all label requests, in eight files that arrive one after another."""
    folder = scratch_dir(q.spark, "feedback")
    requests = q("label_requests")
    number = F.col("comment_id").cast("long")
    for part in range(8):
        part_of = F.least(F.floor(number / SLICE_IDS), F.lit(7)) == part
        requests.filter(part_of).coalesce(1).write.parquet(f"{folder}/in/part={part}")
    stream = q.spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    return jobs.feedback(stream, q("comments_doc"), folder)


#: Comment numbers of a file of requests; the files arrive in this order.
SLICE_IDS = 120


@query(["comments_doc", "label_requests", "model_versions"], """
with labels as (
  select r.* from label_requests r join comments_doc c on r.comment_id = c.comment_id where r.is_spam is not null)
select count(*) as untrained_labels,
       count(case when requested_at > (select max(created_at) from model_versions where model_type = 'spam') then 1 end) as newer_labels,
       count(*) >= 10 as due_by_untrained,
       count(case when requested_at > (select max(created_at) from model_versions where model_type = 'spam') then 1 end) >= 10 as due_by_newer
from labels""")
def stream_feedback(q):
    """The label log of all requests beside the registered models, before any training."""
    labels = q.spark.read.parquet(_feedback(q).labels)
    return feedback.retrain_due(labels, q("model_versions"))


@query(["comments_doc", "label_requests"], """
select comment_id, is_spam, requested_at as updated_at
from (select r.* from label_requests r join comments_doc c on r.comment_id = c.comment_id where r.is_spam is not null)
qualify row_number() over (partition by comment_id order by requested_at desc, request_id desc) = 1""")
def stream_feedback_updates(q):
    """Comment updates of the label requests, the last one of each comment over all micro-batches."""
    written = q.spark.read.parquet(_feedback(q).updates)
    last = feedback.first_per_key(written, "comment_id", [F.desc("batch"), F.desc("updated_at")])
    return last.select("comment_id", "is_spam", "updated_at")


@query(["comments_doc", "label_requests"], """
select r.request_id, r.comment_id, r.requested_at,
       case when r.is_spam is null then 'label is not boolean' else 'comment not found' end as error
from label_requests r left join comments_doc c on r.comment_id = c.comment_id
where r.is_spam is null or c.comment_id is null""")
def stream_feedback_rejects(q):
    """Every request that left no label, with the reason."""
    return q.spark.read.parquet(_feedback(q).rejects).select("request_id", "comment_id", "requested_at", "error")


RETRAIN_SQL = f"""
with recursive judged as (
  select least(cast(r.comment_id as bigint) // {SLICE_IDS}, 7) as part, r.requested_at
  from label_requests r join comments_doc c on r.comment_id = c.comment_id where r.is_spam is not null),
parts as (
  select row_number() over (order by part) as k, count(*) as n, max(requested_at) as newest from judged group by part),
walked as (
  select k, n as labels, n as untrained, newest from parts where k = 1
  union all
  select p.k, p.n, p.n + case when w.untrained >= 10 then 0 else w.untrained end, p.newest
  from walked w join parts p on p.k = w.k + 1)"""


@query(["comments_doc", "label_requests"], f"""{RETRAIN_SQL}
select labels, untrained as untrained_labels, untrained >= 10 as due, case when untrained >= 10 then newest end as trained_at
from walked""")
def stream_retrain(q):
    """Retrain decisions as the files of requests arrive: due at ten untrained labels, which then count no more."""
    return q.spark.read.parquet(_feedback(q).decisions).select("labels", "untrained_labels", "due", "trained_at")


@query(["comments_doc", "label_requests"], f"""{RETRAIN_SQL},
named as (select l.*, dense_rank() over (order by part) as k from judged l)
select (select min_by(w.newest, w.k) from walked w where w.untrained >= 10 and w.k >= n.k) as trained_at, count(*) as labels
from named n group by 1""")
def stream_trained_labels(q):
    """Labels by the training that saw them first; those no training has seen have no stamp."""
    folders = _feedback(q)
    labels, decisions = (q.spark.read.parquet(f) for f in (folders.labels, folders.decisions))
    return counters.stamped(labels, decisions).groupBy("trained_at").agg(F.count("*").alias("labels"))
