"""Queries: sources, sinks, table maintenance, reports and JSON columns (section 2.1 of the survey)."""

from pyspark.sql import functions as F

from threadwise.functions.labels import decode_sentiment, encode_sentiment, parse_api_time
from threadwise.operators import feedback, merge
from threadwise.plans import video_stats
from threadwise.plans.catalog import query
from threadwise.plans.oracle_text import LONG_WORDS_SQL, STATS_SQL, STOP_SQL
from threadwise.plans.report import report_long, report_text, write_reports
from threadwise.schemas import COMMENTS
from threadwise.session import scratch_dir
from threadwise.sources import api, buckets, tables

LOAD_TIME = "2024-02-01 00:00:00"
REPLY_PAGE = 100


def load_time():
    return F.lit(LOAD_TIME).cast("timestamp_ntz")


def thread_documents(q):
    """Landed thread documents as the API would deliver them: one per thread and page of replies."""
    t = q("threads").withColumn("page", F.floor(F.col("turn") / REPLY_PAGE))
    snippet = F.struct(F.col("author").alias("authorDisplayName"), F.col("text").alias("textDisplay"),
                       F.col("likes").alias("likeCount"), F.col("published_at").alias("publishedAt"))
    reply = F.when(F.col("turn") > 0, F.struct("turn", F.col("comment_id").alias("id"), snippet.alias("snippet")))
    pages = t.groupBy("thread_id", "video_id", "page", "thread_replies").agg(
        F.max(F.when(F.col("turn") == 0, snippet)).alias("top"), F.array_sort(F.collect_list(reply)).alias("replies")
    )
    comments = F.transform("replies", lambda r: F.struct(r["id"].alias("id"), r["snippet"].alias("snippet")))
    item = F.struct(
        F.col("thread_id").alias("id"),
        F.struct(F.col("thread_replies").alias("totalReplyCount"),
                 F.when(F.col("top").isNotNull(), F.struct(F.col("top").alias("snippet"))).alias("topLevelComment")).alias("snippet"),
        F.struct(comments.alias("comments")).alias("replies"),
    )
    request = F.struct(F.col("video_id").alias("videoId"))
    return pages.select(F.to_json(F.struct(request.alias("request"), F.array(item).alias("items"))).alias("json"))


def video_documents(q):
    """Landed video documents; a video that is gone has no items."""
    snippet = F.struct(
        F.col("title"), F.col("channel_title").alias("channelTitle"),
        F.struct(F.struct(F.col("thumbnail_url").alias("url")).alias("default")).alias("thumbnails"),
    )
    items = F.filter(F.array(F.struct(snippet.alias("snippet"))), lambda _: ~F.col("gone"))
    request = F.struct(F.col("video_id").alias("videoId"))
    return q("video_pages").select(F.to_json(F.struct(request.alias("request"), items.alias("items"))).alias("json"))


@query(["comments_ev"], """
select comment_id, video_id, author, timestamp, likes, content_class, sentiment, classification, mod_action,
       emotional_score, toxicity_score, spam_score, is_spam, responded from comments_ev""")
def scan_comments(q):
    """Writes nothing: the declared schema is applied at the scan of the stored table."""
    return q("comments_ev").drop("text", "reason", "updated_at")


SINCE = "2024-01-20 12:00:00"


@query(["comments_ev"], f"""
select comment_id, video_id, author, text, timestamp, likes, spam_score, is_spam from comments_ev
where timestamp >= timestamp '{SINCE}'""")
def scan_stored_days(q):
    """Comments written under one folder per day; the scan skips the folders before the time."""
    folder = scratch_dir(q.spark, "days")
    tables.store_by_day(q("comments_ev"), folder)
    since = F.lit(SINCE).cast("timestamp_ntz")
    return tables.scan_since(q.spark, folder, COMMENTS, since).select(
        "comment_id", "video_id", "author", "text", "timestamp", "likes", "spam_score", "is_spam")


THREAD_ROWS = """
select comment_id, video_id, parent_id, coalesce(author, 'Unknown') as author, text, likes,
       strptime(published_at, '%Y-%m-%dT%H:%M:%SZ') as timestamp, reply_count from threads"""


@query(["threads"], THREAD_ROWS + " where turn = 0")
def ingest_threads(q):
    return api.ingest_threads(thread_documents(q), load_time())


@query(["threads"], THREAD_ROWS + " where turn > 0")
def ingest_replies(q):
    return api.ingest_replies(thread_documents(q), load_time())


@query(["threads"], THREAD_ROWS)
def ingest_comments(q):
    return api.ingest_comments(thread_documents(q), load_time())


@query(["video_pages"], """
select video_id, coalesce(title, 'Unknown Title') as title, coalesce(channel_title, 'Unknown Channel') as channel_title,
       thumbnail_url from video_pages where not gone""")
def ingest_videos(q):
    return api.ingest_videos(video_documents(q))


def _load(q):
    """A stored table and a batch holding every row twice, partly stored already."""
    comments = q("comments_ev").select("comment_id", "video_id", "author", "timestamp", "likes", "content_class")
    target = comments.filter("content_class <> 'questionable'")
    once = comments.filter("content_class in ('safe', 'questionable')").withColumn("seq", F.lit(1))
    again = once.withColumns({"seq": F.lit(2), "likes": F.col("likes") + 1})
    return target, once.unionByName(again)


@query(["comments_ev"], """
with batch as (select * from comments_ev where content_class in ('safe', 'questionable')),
both_copies as (select * from batch union all select * from batch)
select video_id, count(*) as fetched,
       count(distinct case when content_class = 'questionable' then comment_id end) as inserted,
       count(*) - count(distinct case when content_class = 'questionable' then comment_id end) as duplicates
from both_copies group by video_id""")
def ingest_counts(q):
    target, batch = _load(q)
    return merge.ingest_counts(target, batch, "comment_id", "video_id")


@query(["comments_ev"], """
select comment_id, video_id, likes, content_class from comments_ev where content_class is not null""")
def insert_if_absent(q):
    target, batch = _load(q)
    merged = merge.insert_if_absent(target, batch, "comment_id", [F.col("seq")])
    return merged.select("comment_id", "video_id", "likes", "content_class")


@query(["comments_ev"], """
select comment_id, video_id, author, cast(0 as bigint) as likes, cast(0 as bigint) as reply_count, classification,
       toxicity_score, cast(null as double) as spam_score, cast(null as boolean) as is_spam from comments_ev""")
def evolve_schema(q):
    old = q("comments_ev").select("comment_id", "video_id", "author", "timestamp", "classification", "toxicity_score")
    first = old.withColumn("seq", F.lit(1))
    second = first.withColumns({"seq": F.lit(2), "author": F.lit("late copy")})
    zero = F.lit(0)
    evolved = merge.evolve_schema(first.unionByName(second), COMMENTS, "comment_id", [F.col("seq")],
                                  {"likes": zero, "reply_count": zero})
    return evolved.select("comment_id", "video_id", "author", "likes", "reply_count", "classification",
                          "toxicity_score", "spam_score", "is_spam")


@query(["comments_ev"], """
with written as (
  select author as video_id, comment_id as title, cast(null as varchar) as thumbnail_url, timestamp as seq, 1 as w
  from comments_ev where content_class = 'toxic'
  union all
  select author, 'stored', 'url', max(timestamp), 0 from comments_ev where content_class = 'safe' group by author)
select video_id, title, thumbnail_url from written
qualify row_number() over (partition by video_id order by w desc, seq desc) = 1""")
def upsert_latest(q):
    comments = q("comments_ev")
    stored = comments.filter("content_class = 'safe'").groupBy(F.col("author").alias("video_id")).agg(
        F.max("timestamp").alias("seq"), F.lit("stored").alias("title"), F.lit("url").alias("thumbnail_url"))
    batch = comments.filter("content_class = 'toxic'").select(
        F.col("author").alias("video_id"), F.col("timestamp").alias("seq"), F.col("comment_id").alias("title"))
    return merge.upsert_latest(stored, batch, "video_id", "seq").drop("seq")


UPDATES = """
last_label as (
  select comment_id, is_spam, requested_at from label_requests where is_spam is not null
  qualify row_number() over (partition by comment_id order by requested_at desc, request_id desc) = 1)"""


@query(["comments_ev", "label_requests"], f"""
with {UPDATES}
select c.comment_id, coalesce(l.is_spam, c.is_spam) as is_spam,
       coalesce(cast(l.is_spam as double), c.spam_score) as spam_score, l.requested_at as updated_at
from comments_ev c left join last_label l on c.comment_id = l.comment_id""")
def apply_updates(q):
    updates = feedback.updates_from(q("label_requests").filter("is_spam is not null"))
    updated = merge.apply_updates(q("comments_ev"), updates, "comment_id")
    return updated.select("comment_id", "is_spam", "spam_score", "updated_at")


@query(["comments_ev", "label_requests"], f"""
with {UPDATES}
select c.comment_id, c.video_id, coalesce(l.is_spam, c.is_spam) as is_spam
from comments_ev c left join last_label l on c.comment_id = l.comment_id""")
def stored_updates(q):
    """Updates written back to the stored table: only the videos with an update are rewritten."""
    folder, schema = scratch_dir(q.spark, "tables") + "/comments", "comment_id STRING, video_id STRING, is_spam BOOLEAN"
    q("comments_ev").select("comment_id", "video_id", "is_spam").write.partitionBy("video_id").parquet(folder)
    updates = feedback.updates_from(q("label_requests").filter("is_spam is not null")).select("comment_id", "is_spam")
    tables.update_stored(q.spark, folder, schema, updates, "comment_id", "video_id")
    return tables.scan_table(q.spark, folder, schema)


STORED = "comment_id STRING, video_id STRING, is_spam BOOLEAN"


def _bucketed(q):
    folder = scratch_dir(q.spark, "store")
    buckets.create_store(q("comments_ev").select("comment_id", "video_id", "is_spam"), folder, "comment_id", 16)
    return folder


@query(["comments_ev", "label_requests"], f"""
with {UPDATES}
select c.comment_id, c.video_id, coalesce(l.is_spam, c.is_spam) as is_spam
from comments_ev c left join last_label l on c.comment_id = l.comment_id""")
def bucket_updates(q):
    """Updates in a bucketed store: the buckets of updated keys are joined without a shuffle of the stored rows."""
    folder = _bucketed(q)
    updates = feedback.updates_from(q("label_requests").filter("is_spam is not null"))
    buckets.change_store(q.spark, folder, STORED, updates.select("comment_id", "is_spam"), "comment_id", [], most=100)
    return buckets.read_store(q.spark, folder, STORED)


@query(["comments_ev"], """
select comment_id, case when cast(comment_id as bigint) % 5 = 0 then 'moved' else video_id end as video_id,
       case when cast(comment_id as bigint) % 5 <> 0 then is_spam end as is_spam from comments_ev
union all
select '-' || comment_id, 'new', true from comments_ev where cast(comment_id as bigint) % 7 = 0""")
def bucket_upserts(q):
    """Whole rows replaced or added in a bucketed store; each version stays readable."""
    folder = _bucketed(q)
    number = F.col("comment_id").cast("long")
    moved = q("comments_ev").filter(number % 5 == 0).select(
        "comment_id", F.lit("moved").alias("video_id"), F.lit(None).cast("boolean").alias("is_spam"))
    new = q("comments_ev").filter(number % 7 == 0).select(
        F.concat(F.lit("-"), "comment_id").alias("comment_id"), F.lit("new").alias("video_id"), F.lit(True).alias("is_spam"))
    buckets.change_store(q.spark, folder, STORED, moved.unionByName(new), "comment_id", [], insert=True)
    return buckets.read_store(q.spark, folder, STORED)


def _lines(number: int, section: str, scalars: list[str], first_line: int = 0) -> str:
    return " union all ".join(
        f"select video_id, cast({number} as bigint) as section_no, '{section}' as section, "
        f"cast({i} as bigint) as line_no, '{c}' as key, cast({c} as varchar) as value from stats"
        for i, c in enumerate(scalars, first_line)
    )


def _listed(number: int, section: str, key: str, value: str, source: str, rank: str) -> str:
    return (f"select video_id, cast({number} as bigint), '{section}', cast({rank} - 1 as bigint), {key}, "
            f"cast({value} as varchar) from {source}")


LINES_SQL = f"""
with {STATS_SQL},
classes as (
  select video_id, classification, count(*) as n, row_number() over (partition by video_id order by classification) as r
  from comments_doc where classification <> '' group by video_id, classification),
actions as (
  select video_id, mod_action, count(*) as n, row_number() over (partition by video_id order by mod_action) as r
  from comments_doc where mod_action <> '' group by video_id, mod_action),
authors as (
  select video_id, author, count(*) as n, row_number() over (partition by video_id order by count(*) desc, author) as r
  from comments_doc group by video_id, author qualify r <= 5),
words as (
  select video_id, keyword, count(*) as n, row_number() over (partition by video_id order by count(*) desc, keyword) as r
  from (select video_id, unnest({LONG_WORDS_SQL}) as keyword from comments_doc)
  where keyword not in ({STOP_SQL}) group by video_id, keyword qualify r <= 10),
word_lines as (select video_id, count(*) as n from words group by video_id),
lines as (
  {_lines(1, 'Overview', ['total_comments', 'unique_authors'])}
  union all {_listed(2, 'Classification Breakdown', 'classification', 'n', 'classes', 'r')}
  union all {_listed(3, 'Moderation Actions', 'mod_action', 'n', 'actions', 'r')}
  union all {_lines(4, 'Engagement Metrics', ['total_comments', 'responded_comments', 'response_rate', 'unique_authors'])}
  union all {_lines(5, 'Time Analysis', ['first_comment', 'last_comment', 'avg_hours_between', 'most_active_hour'])}
  union all {_listed(6, 'Top Commenters', 'author', 'n', 'authors', 'r')}
  union all {_listed(7, 'Keyword Analysis', 'keyword', 'n', 'words', 'r')}
  union all select video_id, 7, 'Keyword Analysis', coalesce(w.n, 0), 'total_word_count', cast(total_word_count as varchar)
            from stats left join word_lines w using (video_id)
  union all select video_id, 7, 'Keyword Analysis', coalesce(w.n, 0) + 1, 'avg_words_per_comment', cast(avg_words_per_comment as varchar)
            from stats left join word_lines w using (video_id)
  union all select * from ({_lines(8, 'Emotional Analysis', ['avg_emotional_score', 'max_emotional_score', 'min_emotional_score', 'positive', 'neutral', 'negative'])})
            where video_id in (select video_id from stats where avg_emotional_score is not null)),
sections as (
  select * from (values (1, 'Overview'), (2, 'Classification Breakdown'), (3, 'Moderation Actions'), (4, 'Engagement Metrics'),
    (5, 'Time Analysis'), (6, 'Top Commenters'), (7, 'Keyword Analysis'), (8, 'Emotional Analysis')) as t(section_no, section))"""
ALL_LINES_SQL = """
select * from lines
union all
select s.video_id, x.section_no, x.section, 0, null, 'No data available' from stats s, sections x
where (s.video_id, x.section_no) not in (select video_id, section_no from lines)"""


@query(["comments_doc"], f"{LINES_SQL}{ALL_LINES_SQL}")
def report_long_form(q):
    return report_long(video_stats.comment_stats_document(q("comments_doc")))


@query(["comments_doc"], f"""{LINES_SQL},
every as ({ALL_LINES_SQL}),
bodies as (
  select video_id, section_no, '## ' || section || chr(10) || string_agg(
           case when key is null then value else '- ' || key || ': ' || coalesce(value, 'None') end, chr(10) order by line_no) as body
  from every group by video_id, section_no, section),
shown as (
  select video_id, row_number() over (partition by video_id order by timestamp, comment_id) as r,
         chr(10) || '- Author: ' || coalesce(author, 'None') || chr(10) || '  Classification: ' || coalesce(classification, 'None')
         || chr(10) || '  Action: ' || coalesce(mod_action, 'None') || chr(10) || '  Emotional Score: '
         || coalesce(cast(emotional_score as varchar), 'None') || chr(10) || '  Text: "'
         || case when length(text) > 100 then substring(text, 1, 100) || '...' else coalesce(text, 'None') end || '"' as sample
  from comments_doc qualify r <= 5),
samples as (select video_id, string_agg(sample, chr(10) order by r) as samples from shown group by video_id)
select video_id, '# Comment Analysis Summary' || chr(10) || 'Generated on: 2024-02-01 00:00:00' || chr(10) || chr(10)
       || string_agg(body, chr(10) || chr(10) order by section_no) || chr(10) || chr(10) || '## Sample Comments' || chr(10)
       || any_value(samples) as report
from bodies join samples using (video_id) group by video_id""")
def report_markdown(q):
    """The reports as text, as they are written to their folders and read back."""
    folder = scratch_dir(q.spark, "reports")
    document = video_stats.comment_stats_document(q("comments_doc"))
    write_reports(report_text(document, F.lit(LOAD_TIME)), folder)
    return q.spark.read.text(folder, wholetext=True).select(
        "video_id", F.regexp_replace("value", "\n$", "").alias("report"))


@query(["comments_doc"], """
select video_id, comment_id, author, substring(text, 1, 100) as text_head, classification, mod_action,
       (select count(*) from comments_doc) as table_rows
from comments_doc qualify row_number() over (partition by video_id order by timestamp, comment_id) <= 5""")
def table_profile(q):
    return tables.table_profile(q("comments_doc"))


@query(["comments_doc"], """
select comment_id, sentiment, emotional_score as compound, toxicity_score as toxicity,
       '{"compound":' is not null as is_text from comments_doc where sentiment is not null""")
def json_columns(q):
    judged = q("comments_doc").filter("sentiment is not null")
    scores = F.create_map(F.lit("compound"), "emotional_score", F.lit("toxicity"), "toxicity_score")
    stored = judged.select("comment_id", encode_sentiment(F.col("sentiment"), scores).alias("document"))
    sentiment, decoded = decode_sentiment(F.col("document"))
    inner = F.get_json_object("document", "$.scores")
    return stored.select("comment_id", sentiment.alias("sentiment"), decoded["compound"].alias("compound"),
                         decoded["toxicity"].alias("toxicity"), inner.startswith('{"compound":').alias("is_text"))


@query(["threads"], """
select comment_id,
       case author when 'user' then strptime(published_at, '%Y-%m-%dT%H:%M:%SZ')
            else timestamp '2024-02-01 00:00:00' end as timestamp from threads""")
def parse_ts(q):
    """Times of user comments are as published, others are damaged or absent."""
    damaged = F.when(F.col("author") == "user", F.col("published_at")).when(
        F.col("author") == "assistant", F.replace("published_at", F.lit("T"), F.lit(" ")))
    return q("threads").select("comment_id", parse_api_time(damaged, load_time()).alias("timestamp"))
