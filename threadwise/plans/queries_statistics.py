"""Queries: filters, joins, aggregates, windows and top-k (sections 2.2 to 2.7 of the survey)."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from threadwise.functions.text import INDICATORS, spam_indicators
from threadwise.operators import feedback, filters, keywords, ordering, quality, statistics, threads
from threadwise.plans import states, video_stats
from threadwise.plans.catalog import query
from threadwise.plans.oracle_text import INDICATORS_SQL, LONG_WORDS_SQL, STATS_SQL, STOP_SQL, WORDS_SQL
from threadwise.session import scratch_dir
from threadwise.sources import pages

# ---- filters and listings


@query(["comments_ev"], "select comment_id, author, timestamp from comments_ev where video_id = 'v3'")
def filter_video(q):
    return filters.filter_video(q("comments_ev"), "v3").select("comment_id", "author", "timestamp")


@query(["comments_ev"], "select comment_id, video_id from comments_ev where classification is null or spam_score is null")
def unanalyzed(q):
    return filters.unanalyzed(q("comments_ev")).select("comment_id", "video_id")


@query(["comments_doc"], "select comment_id, video_id, text from comments_doc where classification is null")
def unclassified(q):
    return filters.unclassified(q("comments_doc")).select("comment_id", "video_id", "text")


@query(["comments_doc"], """
select comment_id, video_id, content_class, sentiment from comments_doc
where content_class = 'questionable' and sentiment = 'positive' and contains(lower(text), lower('The'))""")
def faceted_search(q):
    found = filters.faceted_search(q("comments_doc"), "questionable", "positive", "The")
    return found.select("comment_id", "video_id", "content_class", "sentiment")


@query(["comments_ev"], """
select comment_id, timestamp from comments_ev
where timestamp >= (select max(timestamp) from comments_ev) - interval 7 day""")
def since_days(q):
    return filters.since_days(q("comments_ev"), days=7).select("comment_id", "timestamp")


@query(["comments_ev"], """
select comment_id, is_spam, mod_action from comments_ev where is_spam is not null and mod_action is not null""")
def judged_only(q):
    judged = filters.judged_only(filters.judged_only(q("comments_ev")), "mod_action")
    return judged.select("comment_id", "is_spam", "mod_action")


@query(["comments_doc"], f"""
select video_id, comment_id, text, author, timestamp, classification, toxicity_score,
       coalesce(is_spam, false) as is_spam, spam_score, {', '.join(INDICATORS_SQL[c] + ' as ' + c for c in INDICATORS[:6])}
from comments_doc""")
def video_comments(q):
    comments = spam_indicators(q("comments_doc"))
    schema = ", ".join(f"{c} BIGINT" for c in INDICATORS[:6])
    stored = comments.withColumn("spam_features", F.to_json(F.struct(*INDICATORS[:6])))
    decoded = stored.withColumn("spam_features", F.from_json("spam_features", schema))
    return filters.video_comments(decoded).select("*", "spam_features.*").drop("spam_features")


@query(["comments_doc"], """
select comment_id, coalesce(content_class, 'unclassified') as content_class, coalesce(sentiment, 'neutral') as sentiment
from comments_doc""")
def split_classification(q):
    return filters.with_split_classification(q("comments_doc")).select("comment_id", "content_class", "sentiment")


@query(["comments_doc"], """
select video_id, comment_id, author, classification, mod_action, timestamp, emotional_score,
       case when length(text) > 100 then substring(text, 1, 100) || '...' else text end as text
from comments_doc
qualify row_number() over (partition by video_id order by timestamp, comment_id) <= 5""")
def sample_comments(q):
    return filters.sample_comments(q("comments_doc"))


@query(["comments_ev"], """
select comment_id,
       cast(cast(cast(cast(spam_score * 100 as varchar) as decimal(38,20)) as decimal(6,1)) as varchar) || '%' as spam_display,
       spam_score > cast(0.5 as double) as spam_alert,
       cast(cast(cast(cast(toxicity_score * 100 as varchar) as decimal(38,20)) as decimal(6,1)) as varchar) || '%' as toxicity_display,
       toxicity_score > cast(0.5 as double) as toxicity_alert
from comments_ev""")
def score_display(q):
    shown = filters.score_display(q("comments_ev"))
    return shown.select("comment_id", "spam_display", "spam_alert", "toxicity_display", "toxicity_alert")


# ---- joins


@query(["videos", "comments_ev"], """
select v.video_id, v.title, v.channel_title, v.thumbnail_url, count(c.comment_id) as comment_count,
       min(c.timestamp) as first_comment, max(c.timestamp) as last_comment,
       count(case when c.content_class = 'toxic' then 1 end) as toxic_count,
       count(case when c.content_class = 'questionable' then 1 end) as questionable_count,
       count(case when c.is_spam then 1 end) as spam_count
from videos v left join comments_ev c on v.video_id = c.video_id
group by v.video_id, v.title, v.channel_title, v.thumbnail_url
order by last_comment desc nulls last, v.video_id""")
def video_overview(q):
    return statistics.video_overview(q("videos"), q("comments_ev"))


@query(["comments_ev", "label_requests"], """
select r.request_id, r.comment_id, r.is_spam, r.requested_at, c.author, c.video_id
from label_requests r join comments_ev c on r.comment_id = c.comment_id""")
def label_lookup(q):
    return feedback.label_lookup(q("label_requests"), q("comments_ev"), ["author", "video_id"])


@query(["comments_ev", "label_requests"], """
select distinct request_id, comment_id from label_requests
where comment_id not in (select comment_id from comments_ev)""")
def missing_ids(q):
    return feedback.missing_ids(q("label_requests"), q("comments_ev"))


@query(["threads"], """
select r.comment_id, r.video_id, r.parent_id, r.author, r.text, p.author as parent_author, p.text as parent_text,
       n.replies_found, p.reply_count as replies_declared, n.replies_found = p.reply_count as complete
from threads r left join threads p on r.parent_id = p.comment_id
left join (select parent_id, count(*) as replies_found from threads group by parent_id) n on n.parent_id = r.parent_id
where r.parent_id is not null""")
def thread_join(q):
    return threads.thread_join(q("threads"))


@query(["label_requests", "model_versions"], """
select request_id, comment_id, requested_at as labeled_at from label_requests
where requested_at > (select coalesce(max(created_at), timestamp '1970-01-01 00:00:00')
                      from model_versions where model_type = 'spam')""")
def newer_than_model(q):
    labels = q("label_requests").withColumnRenamed("requested_at", "labeled_at")
    return feedback.newer_than_model(labels, q("model_versions")).select("request_id", "comment_id", "labeled_at")


# ---- aggregates


@query(["comments_ev"], "select video_id, classification, count(*) as n from comments_ev group by all")
def class_counts(q):
    return statistics.class_counts(q("comments_ev"))


@query(["comments_ev"], """
select video_id, classification, count(*) as n from comments_ev
where classification is not null and classification <> '' group by all""")
def class_breakdown(q):
    return statistics.class_breakdown(q("comments_ev"))


@query(["comments_ev"], """
select video_id, mod_action, count(*) as n from comments_ev where mod_action is not null group by all""")
def mod_action_counts(q):
    return statistics.mod_action_counts(q("comments_ev"))


@query(["comments_ev"], """
select video_id,
       count(case when emotional_score >= cast(0.3 as double) then 1 end) as positive,
       count(case when emotional_score between cast(-0.3 as double) and cast(0.3 as double) then 1 end) as neutral,
       count(case when emotional_score <= cast(-0.3 as double) then 1 end) as negative
from comments_ev group by video_id""")
def emotion_bands(q):
    return statistics.emotion_bands(q("comments_ev"))


@query(["comments_ev"], """
select video_id, count(emotional_score) > 0 as has_scores, round(avg(emotional_score), 2) + 0.0 as avg_emotional_score,
       round(max(emotional_score), 2) as max_emotional_score, round(min(emotional_score), 2) as min_emotional_score,
       count(case when emotional_score > cast(0.5 as double) then 1 end) as positive,
       count(case when emotional_score >= cast(0.3 as double) and emotional_score <= cast(0.7 as double) then 1 end) as neutral,
       count(case when emotional_score < cast(0.5 as double) then 1 end) as negative
from comments_ev group by video_id""")
def emotion_stats(q):
    return statistics.emotion_stats(q("comments_ev"))


@query(["comments_ev"], """
select video_id, count(*) as total_comments, count(case when responded then 1 end) as responded_comments,
       round(count(case when responded then 1 end) * 100 / cast(count(*) as double), 2) as response_rate,
       count(distinct author) as unique_authors
from comments_ev group by video_id""")
def engagement(q):
    return statistics.engagement(q("comments_ev"))


@query(["comments_ev"], """
with per_author as (
  select video_id, author, count(*) as comment_count,
         round(coalesce(sum(emotional_score), 0) / count(*), 2) + 0.0 as avg_emotional_score,
         round(avg(emotional_score), 2) + 0.0 as avg_scored,
         row_number() over (partition by video_id order by count(*) desc, author) as author_rank
  from comments_ev group by video_id, author),
per_class as (
  select video_id, author, classification, count(*) as class_count from comments_ev
  where classification <> '' group by all)
select a.*, c.classification, c.class_count
from per_author a left join per_class c on a.video_id = c.video_id and a.author = c.author
where author_rank <= 5""")
def top_commenters(q):
    top = statistics.top_commenters(q("comments_ev"))
    return top.select("video_id", "author", "comment_count", "avg_emotional_score", "avg_scored", "author_rank",
                      F.explode_outer("classifications").alias("classification", "class_count"))


@query(["comments_ev"], """
select cast(timestamp as date) as day, count(*) as total, count(case when is_spam then 1 end) as spam,
       count(case when is_spam then 1 end) / cast(count(*) as double) as ratio
from comments_ev where timestamp >= (select max(timestamp) from comments_ev) - interval 30 day
group by cast(timestamp as date) order by day""")
def spam_trends(q):
    return statistics.spam_trends(q("comments_ev"))


@query(["comments_ev"], """
select video_id, count(case when is_spam then 1 end) as spam_samples, count(case when not is_spam then 1 end) as ham_samples,
       count(*) as total_samples
from comments_ev where is_spam is not null group by video_id""")
def sample_counts(q):
    return statistics.sample_counts(q("comments_ev"))


@query(["spam_training"], """
select count(*) as total_samples, count(case when is_spam then 1 end) as spam_samples,
       count(case when not is_spam then 1 end) as ham_samples from spam_training""")
def training_counts(q):
    return statistics.training_counts(q("spam_training"))


@query(["videos", "comments_ev", "spam_training"], """
select 'comments' as table_name, count(*) as n from comments_ev
union all select 'videos', count(*) from videos
union all select 'spam_training', count(*) from spam_training
union all select 'untrained_labels', count(*) from spam_training where trained_at is null""")
def table_counts(q):
    labels = q("spam_training")
    return statistics.table_counts({
        "comments": q("comments_ev"), "videos": q("videos"), "spam_training": labels,
        "untrained_labels": labels.filter("trained_at is null"),
    })


@query(["comments_ev"], "select video_id, count(*) as n from comments_ev group by video_id")
def video_counts(q):
    return statistics.video_counts(q("comments_ev"))


STATS_COLUMNS = """total_comments, responded_comments, response_rate, unique_authors,
avg_emotional_score, max_emotional_score, min_emotional_score, positive, neutral, negative,
first_comment, last_comment, most_active_hour, avg_hours_between, total_word_count, avg_words_per_comment"""


@query(["comments_doc"], f"""with {STATS_SQL}
select video_id, {STATS_COLUMNS} from stats
union all select cast(null as varchar) as video_id, {STATS_COLUMNS} from stats_all""")
def comment_stats(q):
    return video_stats.comment_stats(q("comments_doc"))


@query(["comments_doc"], f"""
with bands as (
  select video_id,
         count(case when emotional_score >= cast(0.3 as double) then 1 end) as positive,
         count(case when emotional_score between cast(-0.3 as double) and cast(0.3 as double) then 1 end) as neutral,
         count(case when emotional_score <= cast(-0.3 as double) then 1 end) as negative
  from comments_doc group by video_id),
class_json as (
  select video_id, '{{' || string_agg('"' || coalesce(classification, 'null') || '":' || n, ',' order by coalesce(classification, 'null')) || '}}' as classifications
  from (select video_id, classification, count(*) as n from comments_doc group by all) group by video_id),
action_json as (
  select video_id, '{{' || string_agg('"' || mod_action || '":' || n, ',' order by mod_action) || '}}' as mod_actions
  from (select video_id, mod_action, count(*) as n from comments_doc where mod_action is not null group by all) group by video_id),
kept as (select video_id, unnest({WORDS_SQL}) as keyword from comments_doc),
ranked as (
  select video_id, keyword, count(*) as n, row_number() over (partition by video_id order by count(*) desc, keyword) as r
  from kept where keyword not in ({STOP_SQL}) group by video_id, keyword),
word_json as (
  select video_id, '{{' || string_agg('"' || keyword || '":' || n, ',' order by r) || '}}' as top_keywords
  from ranked where r <= 10 group by video_id)
select b.*, coalesce(classifications, '{{}}') as classifications, coalesce(mod_actions, '{{}}') as mod_actions,
       coalesce(top_keywords, '{{}}') as top_keywords
from bands b left join class_json using (video_id) left join action_json using (video_id) left join word_json using (video_id)""")
def analysis_summary(q):
    return video_stats.analysis_summary(q("comments_doc"))


@query(["comments_ev"], """
select content_class, sentiment, count(*) as n, cast(grouping_id(content_class, sentiment) as bigint) as level
from comments_ev group by cube(content_class, sentiment)""")
def facet_counts(q):
    return statistics.facet_counts(q("comments_ev"))


@query(["comments_ev"], """
select video_id, date_trunc('hour', timestamp) as hour, count(*) as n from comments_ev group by all""")
def timeline(q):
    return statistics.timeline(q("comments_ev"))


@query(["comments_ev"], "select video_id, count(distinct author) as unique_authors from comments_ev group by video_id")
def distinct_authors(q):
    return statistics.distinct_authors(q("comments_ev"))


# ---- windows


@query(["comments_ev"], """
select video_id, comment_id,
       round((epoch_us(timestamp) - epoch_us(lag(timestamp) over (partition by video_id order by timestamp, comment_id)))
             / cast(3600000000 as double), 6) as gap_hours
from comments_ev""")
def comment_gaps(q):
    gaps = ordering.comment_gaps(q("comments_ev").select("video_id", "comment_id", "timestamp"))
    return gaps.select("video_id", "comment_id", F.round("gap_hours", 6).alias("gap_hours"))


@query(["spam_training"], """
select comment_id, is_spam, seq from spam_training
qualify row_number() over (partition by comment_id order by labeled_at desc) = 1""")
def latest_label(q):
    return feedback.latest_label(q("spam_training")).select("comment_id", "is_spam", "seq")


QUEUE_BATCHES = """
select video_id, comment_id, cast(ceil(r / 10.0) as bigint) as batch_no, (r - 1) % 10 + 1 as comment_no
from (select video_id, comment_id, row_number() over (partition by video_id order by timestamp, comment_id) as r
      from comments_ev where classification is null)"""


@query(["comments_ev"], QUEUE_BATCHES)
def moderation_batches(q):
    queue = filters.unclassified(q("comments_ev")).select("video_id", "comment_id", "timestamp")
    return ordering.moderation_batches(queue).drop("timestamp")


@query(["comments_ev"], """
with hours as (
  select video_id, hour(timestamp) as h, count(*) as n, min(timestamp) as seen from comments_ev group by all),
best as (
  select video_id, h from hours
  qualify row_number() over (partition by video_id order by n desc, seen) = 1)
select c.video_id, min(timestamp) as first_comment, max(timestamp) as last_comment, any_value(b.h) as most_active_hour,
       round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / cast(3600000000 as double) / (count(*) - 1), 2)
         as avg_hours_between
from comments_ev c join best b on c.video_id = b.video_id group by c.video_id""")
def time_patterns(q):
    return statistics.time_patterns(q("comments_ev"))


# ---- top-k and pages


@query(["comments_ev"], """
with numbered as (
  select *, row_number() over (partition by video_id order by timestamp desc, comment_id) as r,
         count(*) over (partition by video_id) as total
  from comments_ev)
select comment_id, video_id, author, timestamp, classification, mod_action, emotional_score, is_spam, spam_score, total,
       cast(2 as bigint) as page, cast(50 as bigint) as per_page, cast(ceil(total / 50.0) as bigint) as total_pages
from numbered where r > 50 and r <= 100""")
def comments_page(q):
    listed = q("comments_ev").select("comment_id", "video_id", "author", "timestamp", "classification", "mod_action",
                                     "emotional_score", "is_spam", "spam_score")
    return ordering.comments_page(listed, page=2)


@query(["comments_ev"], """
with numbered as (
  select comment_id, video_id, author, timestamp, row_number() over (order by timestamp desc, comment_id) as r,
         count(*) over () as total
  from comments_ev where video_id = 'v3')
select comment_id, video_id, author, timestamp, total, cast(ceil(total / 14.0) as bigint) - 1 as page,
       cast(14 as bigint) as per_page, cast(ceil(total / 7.0 / 2) as bigint) as total_pages
from numbered where r > (cast(ceil(total / 14.0) as bigint) - 2) * 14 and r <= (cast(ceil(total / 14.0) as bigint) - 1) * 14""")
def deep_page(q):
    """The last page but one of a video, out of the hours that the page directory names."""
    folder, schema = scratch_dir(q.spark, "pages"), "comment_id STRING, video_id STRING, author STRING, timestamp TIMESTAMP_NTZ"
    pages.store_with_directory(q("comments_ev").select("comment_id", "video_id", "author", "timestamp"), folder)
    last = pages.stored_page(q.spark, folder, schema, "v3", per_page=14).first()["total_pages"]
    return pages.stored_page(q.spark, folder, schema, "v3", last - 1, per_page=14)


def _states(q):
    """States of all comments, the last days added after the others."""
    folder, comments = scratch_dir(q.spark, "states"), q("comments_ev")
    late = F.to_date("timestamp") >= F.lit("2024-01-20").cast("date")
    states.store_states(comments.filter(~late), folder)
    states.store_states(comments.filter(late), folder)
    return folder


STATES_SQL = f"""
select video_id, count(*) as total, count(classification) as judged, count(case when is_spam then 1 end) as spam_flagged,
       {", ".join(f"count(case when content_class = '{c}' then 1 end) as class_{c}" for c in states.CLASSES)},
       count(emotional_score) as scored, count(case when responded then 1 end) as responded,
       cast(sum(likes) as bigint) as likes, min(timestamp) as first_at, max(timestamp) as last_at,
       count(distinct author) as distinct_authors, round(cast(sum(cast(emotional_score as decimal(18,9))) as double) / count(emotional_score), 6) as avg_emotion
from comments_ev"""


@query(["comments_ev"], f"{STATES_SQL} group by video_id")
def incremental_statistics(q):
    """Statistics merged from daily states, authors counted."""
    return states.merged(q.spark, _states(q), exact=True).withColumn("avg_emotion", F.round("avg_emotion", 6))


@query(["comments_ev"], """
select video_id, count(*) as total, true as near from comments_ev where timestamp >= timestamp '2024-01-10 00:00:00' group by video_id""")
def author_sketches(q):
    """Authors of the days from a date on by merged sketches: within six standard errors and a half of one of the exact number."""
    folder = _states(q)
    near, exact = (states.merged(q.spark, folder, e, since="2024-01-10") for e in (False, True))
    both = near.select("video_id", "total", "distinct_authors").join(
        exact.select("video_id", F.col("distinct_authors").alias("counted")), "video_id")
    error = F.abs(F.col("distinct_authors") - F.col("counted"))
    return both.select("video_id", "total", (error <= 0.1 * F.col("counted") + 0.5).alias("near"))


@query(["comments_doc"], f"""
with kept as (select unnest({LONG_WORDS_SQL}) as keyword from comments_doc)
select keyword, count(*) as n from kept group by keyword order by n desc, keyword limit 10""")
def top_terms_k(q):
    counts = keywords.word_counts(q("comments_doc"), keywords.long_tokens, [])
    merged = counts.groupBy("keyword").agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n"), "keyword").limit(10)


# ---- keywords

RANKED_WORDS = f"""
counted as (
  select video_id, keyword, count(*) as n from (select video_id, unnest({LONG_WORDS_SQL}) as keyword from comments_doc)
  where keyword not in ({STOP_SQL}) group by video_id, keyword),
ranked as (
  select *, row_number() over (partition by video_id order by n desc, keyword) as keyword_rank from counted)"""


@query(["comments_doc"], f"""
select video_id, keyword, count(*) as n, row_number() over (partition by video_id order by count(*) desc, keyword) as keyword_rank
from (select video_id, unnest({WORDS_SQL}) as keyword from comments_doc)
where keyword not in ({STOP_SQL}) group by video_id, keyword
qualify row_number() over (partition by video_id order by count(*) desc, keyword) <= 10""")
def keywords_summary(q):
    return keywords.keywords_summary(q("comments_doc"))


@query(["comments_doc"], f"""
with {RANKED_WORDS},
words as (select video_id, cast(sum(n) as bigint) as total_word_count from counted group by video_id),
rows as (select video_id, count(*) as c from comments_doc group by video_id)
select r.*, w.total_word_count, round(w.total_word_count / cast(c as double), 2) as avg_words_per_comment
from ranked r join words w using (video_id) join rows using (video_id) where keyword_rank <= 10""")
def keywords_insight(q):
    return keywords.keywords_insight(q("comments_doc"))


@query(["comments_doc"], f"""
with {RANKED_WORDS}
select *, round(greatest(1.0, least(4.0, log2(n))), 6) as weight from ranked where keyword_rank <= 10""")
def keyword_weight(q):
    cloud = keywords.keyword_cloud(q("comments_doc"))
    return cloud.withColumn("weight", F.round("weight", 6))


# ---- data quality


@query(["videos", "comments_doc", "threads", "label_requests", "comments_ev"], """
select 'comment without video' as violation, comment_id as row_id, video_id as missing_key from comments_doc
where video_id not in (select video_id from videos)
union all
select 'reply without parent', comment_id, parent_id from threads
where parent_id is not null and parent_id not in (select comment_id from threads)
union all
select 'label without comment', request_id, comment_id from label_requests
where comment_id not in (select comment_id from comments_ev)""")
def orphan_rows(q):
    def named(df, violation, row_id, key):
        return df.select(F.lit(violation).alias("violation"), F.col(row_id).alias("row_id"), F.col(key).alias("missing_key"))

    threads_ = q("threads")
    comments = quality.orphan_rows(q("comments_doc"), "video_id", q("videos"), "video_id", "comment_id")
    replies = quality.orphan_rows(threads_, "parent_id", threads_, "comment_id", "comment_id")
    labels = quality.orphan_rows(q("label_requests"), "comment_id", q("comments_ev"), "comment_id", "request_id")
    return (
        named(comments, "comment without video", "comment_id", "video_id")
        .unionByName(named(replies, "reply without parent", "comment_id", "parent_id"))
        .unionByName(named(labels, "label without comment", "request_id", "comment_id"))
    )


@query(["spam_training", "comments_ev", "videos"], """
select 'spam_training' as table_name, comment_id as key, count(*) as n from spam_training group by comment_id having count(*) > 1
union all select 'comments', comment_id, count(*) from (select comment_id from comments_ev union all
  select comment_id from comments_ev where video_id = 'v3') group by comment_id having count(*) > 1
union all select 'videos', video_id, count(*) from videos group by video_id having count(*) > 1""")
def duplicate_keys(q):
    """Keys of the declared tables that come twice; the comments of one video are loaded twice here."""
    comments = q("comments_ev").select("comment_id", "video_id")
    twice = comments.unionByName(comments.filter("video_id = 'v3'"))
    checks = {"spam_training": (q("spam_training"), "comment_id"), "comments": (twice, "comment_id"), "videos": (q("videos"), "video_id")}
    found = [quality.duplicate_keys(df, key).select(F.lit(name).alias("table_name"), F.col(key).alias("key"), "n")
             for name, (df, key) in checks.items()]
    return reduce(DataFrame.unionByName, found)


@query(["threads"], """
select 'video_id' as column_name, count(*) - count(video_id) as nulls from threads
union all select 'comment_id', count(*) - count(comment_id) from threads
union all select 'author', count(*) - count(author) from threads
union all select 'text', count(*) - count(text) from threads
union all select 'timestamp', count(*) - count(published_at) from threads""")
def null_violations(q):
    """NULLs in the columns that a comment table declares NOT NULL."""
    return quality.null_violations(q("threads").withColumn("timestamp", F.col("published_at")))
