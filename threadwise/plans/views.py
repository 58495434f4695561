"""Comment tables derived from the test tables, as SQL text that Spark and a SQL oracle both run.

The few words that differ between the engines are named in braces and listed in DIALECTS.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from threadwise.sources.tables import scan_table
from threadwise.streaming.jobs import read_stream

DIALECTS = {
    "spark": {
        "ts": "timestamp_ntz", "ntz": "timestamp_ntz",
        "doc_minutes": "make_dt_interval(0, 0, cast(d.doc_id % 43200 as int), 0)",
        "one_day": "interval '1' day",
    },
    "duckdb": {
        "ts": "timestamp", "ntz": "timestamp",
        "doc_minutes": "to_minutes(cast(d.doc_id % 43200 as integer))",
        "one_day": "interval '1' day",
    },
}

# Raw tables read by each view, then the views it is built on.
VIEWS: dict[str, tuple[list[str], str]] = {
    "videos": (["nation", "region"], """
        select concat('v', cast(n_nationkey as string)) as video_id, n_name as title, r_name as channel_title,
               cast(null as string) as thumbnail_url
        from nation join region on n_regionkey = r_regionkey"""),
    "comments_ev": (["events"], """
        select comment_id, video_id, author, text, timestamp, likes, content_class, sentiment,
               content_class || ':' || sentiment as classification,
               mod_action, cast(null as string) as reason, emotional_score, toxicity_score, spam_score, is_spam, responded,
               cast(null as {ntz}) as updated_at
        from (
          select cast(event_id as string) as comment_id, concat('v', cast(event_id % 20 as string)) as video_id,
                 concat('u', cast(user_id as string)) as author, props as text, ts as timestamp,
                 cast(floor(value) as bigint) as likes,
                 case event_type when 'error' then 'spam' when 'click' then 'questionable' when 'view' then 'toxic'
                                 when 'purchase' then 'safe' end as content_class,
                 case event_type when 'purchase' then 'positive' when 'error' then 'negative' when 'signup' then null
                                 else 'neutral' end as sentiment,
                 case event_type when 'error' then 'remove' when 'click' then 'flag' when 'purchase' then 'allow'
                                 end as mod_action,
                 case when event_type <> 'signup' then least(value, cast(100 as double)) / 50 - 1 end as emotional_score,
                 cast(event_id % 101 as double) / 100 as toxicity_score,
                 case when event_type <> 'signup' then least(value, cast(100 as double)) / 100 end as spam_score,
                 case when event_type <> 'signup' then event_type = 'error' end as is_spam,
                 user_id % 3 = 0 as responded
          from events) as e"""),
    "model_scores": (["documents"], """
        select cast(d.doc_id as string) as comment_id, cast(d.doc_id % 101 as double) / 100 as p,
               cast(d.doc_id * 37 % 101 as double) / 100 as toxic, cast(d.doc_id * 53 % 101 as double) / 100 as insult,
               cast(d.doc_id * 71 % 101 as double) / 100 as threat,
               cast(d.doc_id * 59 % 201 as double) / 100 - 1 as compound
        from documents as d"""),
    "comments_doc": (["documents", "labels"], """
        select comment_id, video_id, author, text, timestamp, likes, is_spam, spam_score, toxicity_score,
               emotional_score, responded, content_class, sentiment, content_class || ':' || sentiment as classification,
               case content_class when 'spam' then 'remove' when 'safe' then 'allow' when 'toxic' then 'flag'
                                  when 'questionable' then 'flag' end as mod_action,
               cast(null as string) as reason, cast(null as {ntz}) as updated_at
        from (
          select s.*,
                 case when is_spam is null then null when spam_score >= cast(0.85 as double) then 'spam'
                      when toxicity_score >= cast(0.8 as double) then 'toxic'
                      when toxicity_score >= cast(0.5 as double) or spam_score >= cast(0.6 as double) then 'questionable'
                      else 'safe' end as content_class,
                 case when is_spam is null then null when emotional_score > cast(0.05 as double) then 'positive'
                      when emotional_score < cast(-0.05 as double) then 'negative' else 'neutral' end as sentiment
          from (
            select cast(d.doc_id as string) as comment_id, d.source as video_id,
                   concat(d.lang, '-', cast(d.doc_id % 7 as string)) as author, d.text as text,
                   {ts} '2024-01-01 00:00:00' + {doc_minutes} as timestamp,
                   cast(d.n_chars % 50 as bigint) as likes,
                   case when l.doc_id is not null then l.toxic = 1 end as is_spam,
                   case when l.doc_id is not null then cast(d.doc_id % 101 as double) / 100 end as spam_score,
                   case when l.doc_id is not null then cast(d.doc_id * 37 % 101 as double) / 100 end as toxicity_score,
                   case when l.doc_id is not null then cast(d.doc_id * 59 % 201 as double) / 100 - 1 end as emotional_score,
                   d.doc_id % 3 = 0 as responded
            from documents as d left join labels as l on d.doc_id = l.doc_id) as s) as c"""),
    "threads": (["conversations"], """
        select concat('c', cast(c.conv_id as string), '-', cast(c.turn as string)) as comment_id,
               concat('c', cast(c.conv_id as string), '-0') as thread_id, c.turn as turn,
               concat('v', cast(c.conv_id % 25 as string)) as video_id,
               case when c.turn > 0 then concat('c', cast(c.conv_id as string), '-0') end as parent_id,
               case when c.role <> 'system' then c.role end as author, c.text as text,
               cast(length(c.text) % 50 as bigint) as likes,
               concat('2024-01-', lpad(cast(c.conv_id % 28 + 1 as string), 2, '0'), 'T',
                      lpad(cast(c.turn % 24 as string), 2, '0'), ':',
                      lpad(cast(c.conv_id % 60 as string), 2, '0'), ':00Z') as published_at,
               r.replies as thread_replies, case when c.turn = 0 then r.replies else 0 end as reply_count
        from conversations as c
        join (select conv_id, count(*) - 1 as replies from conversations group by conv_id) as r on c.conv_id = r.conv_id"""),
    "label_requests": (["events"], """
        select cast(user_id as string) as request_id, cast(event_id * 3 as string) as comment_id,
               case when value >= 5 then value > 50 end as is_spam, ts as requested_at
        from events where event_type = 'click'"""),
    "spam_training": (["documents", "labels"], """
        select cast(d.doc_id as string) as comment_id, d.text as text, l.toxic = 1 as is_spam,
               cast(1 as double) as confidence, cast(1 as bigint) as seq,
               {ts} '2024-01-01 00:00:00' + {doc_minutes} as labeled_at,
               {ts} '2024-01-01 00:00:00' + {doc_minutes} as trained_at
        from documents as d join labels as l on d.doc_id = l.doc_id
        union all
        select cast(d.doc_id as string), d.text, l.toxic = 0, cast(1 as double), cast(2 as bigint),
               {ts} '2024-01-01 00:00:00' + {doc_minutes} + {one_day}, cast(null as {ntz})
        from documents as d join labels as l on d.doc_id = l.doc_id where l.quality = 0"""),
    "model_versions": (["events"], """
        select case when value < 20 then 'toxicity' else 'spam' end as model_type,
               concat('v', cast(event_id as string)) as version,
               concat('{{"accuracy":', cast(cast(value / 1000 as decimal(10, 5)) as string), ',"total_samples":', cast(user_id as string), '}}') as metrics,
               '{{}}' as parameters, ts as created_at
        from events where event_type = 'signup' and ts < {ts} '2024-01-20 00:00:00'"""),
    "video_pages": (["pages"], """
        select concat('p', cast(page_id as string)) as video_id,
               nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title,
               case when url not like 'http://%' then regexp_extract(url, '://([^/]+)/', 1) end as channel_title,
               case when url not like '%?%' then url end as thumbnail_url,
               url like '%.org/%' as gone
        from pages"""),
}


def view_sql(name: str, dialect: str) -> str:
    return VIEWS[name][1].format(**DIALECTS[dialect]).strip()


def oracle_with(names: list[str], body: str) -> str:
    """A query text with the views it uses as common table expressions; body may start with further ones."""
    parts = [f"{name} as ({view_sql(name, 'duckdb')})" for name in names]
    for start in ("with recursive ", "with "):
        if body.lstrip().startswith(start):
            return start + ",\n".join([*parts, body.lstrip()[len(start):]])
    return "with " + ",\n".join(parts) + "\n" + body if parts else body


# Declared schemas of the test tables in use.
TABLES = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


#: Tables with long texts.
TEXT_TABLES = ("documents",)


@dataclass(frozen=True)
class Tables:
    """The tables of a folder and the views over them."""

    spark: SparkSession
    sf_dir: str
    #: Tasks that the text tables are dealt out over, None as they are stored.
    spread: int | None = None

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def raw(self, table: str) -> DataFrame:
        spread = self.spread if table in TEXT_TABLES else None
        return scan_table(self.spark, self.path(table), TABLES[table], spread)

    def stream(self, table: str) -> DataFrame:
        # A glob, because a table may be one file or a folder of files.
        return read_stream(self.spark, f"{self.path(table)}*", TABLES[table])

    def __call__(self, name: str, streamed: str | None = None) -> DataFrame:
        """A view, with one of its tables read as a stream if asked."""
        tables, _ = VIEWS[name]
        for table in tables:
            frame = self.stream(table) if table == streamed else self.raw(table)
            frame.createOrReplaceTempView(table)
        return self.spark.sql(view_sql(name, "spark"))
