from collections import Counter

from pyspark.sql import functions as F

from conftest import at, rows
from threadwise.operators import filters, keywords, ordering, statistics as S
from threadwise.plans import video_stats
from threadwise.plans.report import report_long, report_text, write_reports
from threadwise.session import scratch_dir

DDL = ("comment_id STRING, video_id STRING, author STRING, text STRING, timestamp TIMESTAMP_NTZ, classification STRING, "
       "mod_action STRING, emotional_score DOUBLE, responded BOOLEAN, content_class STRING, is_spam BOOLEAN")


def sample(table):
    return table(DDL, [
        ("1", "v", "al", "Good good the day", at(1, 10), "safe:positive", "allow", 0.3, True, "safe", False),
        ("2", "v", "bo", "a bad Day_1", at(1, 10, 30), "toxic:negative", "", -0.3, False, "toxic", None),
        ("3", "v", "al", "x" * 120, at(2, 9), None, None, None, None, None, True),
        ("4", "v", "al", "", at(2, 9), "", "flag", 0.7, False, "questionable", True),
        ("5", "w", "cy", "only one", at(3, 5), None, None, None, False, None, None),
        ("6", "lost", "cy", "no video row", at(3, 6), None, None, 0.5, False, None, None),
    ])


def test_overview_keeps_videos_without_comments(table):
    videos = table("video_id STRING, title STRING, channel_title STRING, thumbnail_url STRING",
                   [("v", "t", "c", None), ("w", "t", "c", None), ("empty", "t", "c", None)])
    got = [tuple(r)[:1] + tuple(r)[4:] for r in S.video_overview(videos, sample(table)).collect()]
    assert got == [("w", 1, at(3, 5), at(3, 5), 0, 0, 0), ("v", 4, at(1, 10), at(2, 9), 1, 1, 2), ("empty", 0, None, None, 0, 0, 0)]


def test_counts(table):
    df = sample(table).filter("video_id = 'v'")
    assert rows(S.class_counts(df), "classification", "n") == [(None, 1), ("", 1), ("safe:positive", 1), ("toxic:negative", 1)]
    assert rows(S.class_breakdown(df), "classification", "n") == [("safe:positive", 1), ("toxic:negative", 1)]
    assert rows(S.mod_action_counts(df), "mod_action", "n") == [("", 1), ("allow", 1), ("flag", 1)]
    assert rows(S.mod_action_counts(df, drop_empty=True), "mod_action", "n") == [("allow", 1), ("flag", 1)]
    assert rows(S.sample_counts(df)) == [("v", 2, 1, 3)]
    assert rows(S.distinct_authors(df)) == [("v", 2)]
    assert rows(S.video_counts(df)) == [("v", 4)]
    facets = {(r["content_class"], r["sentiment"], r["level"]): r["n"]
              for r in S.facet_counts(filters.with_split_classification(df)).collect()}
    assert facets[(None, None, 3)] == 4 and facets[("unclassified", None, 1)] == 2 and facets[(None, "positive", 2)] == 1


def test_emotion_bands_overlap(table):
    df = sample(table)
    assert rows(S.emotion_bands(df.filter("video_id = 'v'"))) == [("v", 2, 2, 1)]
    got = {r["video_id"]: tuple(r)[1:] for r in S.emotion_stats(df).collect()}
    assert got["v"] == (True, 0.23, 0.7, -0.3, 1, 2, 2)
    assert got["w"] == (False, None, None, None, 0, 0, 0)


def test_engagement_and_commenters(table):
    df = sample(table).filter("video_id = 'v'")
    assert rows(S.engagement(df)) == [("v", 4, 1, 25.0, 2)]
    got = rows(S.top_commenters(df), "author", "comment_count", "avg_emotional_score", "avg_scored", "classifications", "author_rank")
    assert got == [("al", 3, 0.33, 0.5, {"safe:positive": 1}, 1), ("bo", 1, -0.3, -0.3, {"toxic:negative": 1}, 2)]


def test_commenter_ties_follow_the_name(table):
    df = table("video_id STRING, author STRING, classification STRING, emotional_score DOUBLE",
               [("v", a, None, None) for a in "gfedcba"])
    assert [r[0] for r in rows(S.top_commenters(df), "author")] == list("abcde")


def test_time_patterns(table):
    got = {r["video_id"]: (r["first_comment"], r["last_comment"], r["most_active_hour"], r["avg_hours_between"])
           for r in S.time_patterns(sample(table)).collect()}
    assert got["v"] == (at(1, 10), at(2, 9), 10, 7.67)
    assert got["w"] == (at(3, 5), at(3, 5), 5, 0.0)
    nothing = table("video_id STRING, timestamp TIMESTAMP_NTZ", [("v", None)])
    assert rows(S.time_patterns(nothing)) == []


def test_trends_and_history_window(table):
    got = rows(S.spam_trends(sample(table), days=1, as_of=F.lit(at(3, 6))), "day", "total", "spam", "ratio")
    assert [(r[0].day, *r[1:]) for r in got] == [(2, 2, 2, 1.0), (3, 2, 0, 0.0)]
    assert filters.since_days(sample(table), days=0).count() == 1


def test_keywords(table):
    df = sample(table).filter("video_id = 'v'")
    got = rows(keywords.keywords_summary(df), "keyword_rank", "keyword", "n")
    assert got == [(1, "good", 2), (2, "bad", 1), (3, "day", 1), (4, "day_1", 1), (5, "x" * 120, 1)]
    insight = rows(keywords.keywords_insight(table(DDL, []).unionByName(sample(table))), "video_id", "keyword", "n", "total_word_count", "avg_words_per_comment")
    assert ("v", "good", 2, 6, 1.5) in insight and ("w", "only", 1, 2, 2.0) in insight
    assert rows(ordering.top_terms(df, "author", 1)) == [("al", 3)]


def test_search_and_listing(table):
    df = sample(table)
    assert rows(filters.faceted_search(df, "toxic", "negative", "BAD day"), "comment_id") == [("2",)]
    assert filters.faceted_search(df, query="%").count() == 0
    texts = {r["comment_id"]: r["text"] for r in filters.sample_comments(df).collect()}
    assert texts["3"] == "x" * 100 + "..." and texts["4"] == ""
    assert rows(filters.unanalyzed(df.withColumn("spam_score", F.lit(0.1))), "comment_id") == [("3",), ("5",), ("6",)]
    assert filters.unclassified(df, "w").count() == 1


def big(spark, count=5000):
    """One video holds a third of the rows, many of them in the same hour or at the same time."""
    ids = spark.range(count).withColumn("video_id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 7)))
    start = F.lit(at(1)).cast("timestamp_ntz")
    minutes = F.make_dt_interval(mins=F.pmod(F.col("id") * 7919, F.lit(700)).cast("int"))
    return ids.select(F.lpad(F.col("id").cast("string"), 6, "0").alias("comment_id"), "video_id",
                      F.when(F.col("id") % 501 != 0, start + minutes).alias("timestamp"))


def test_row_numbers_and_gaps_match_brute_force(spark):
    df = big(spark).filter("timestamp is not null")
    numbered = ordering.row_number_per_video(ordering.comment_gaps(df), "n").collect()
    by_video = {}
    for r in numbered:
        by_video.setdefault(r["video_id"], []).append(r)
    assert len(numbered) == df.count()
    for found in by_video.values():
        found.sort(key=lambda r: (r["timestamp"], r["comment_id"]))
        assert [r["n"] for r in found] == list(range(1, len(found) + 1))
        gaps = [None] + [(b["timestamp"] - a["timestamp"]).total_seconds() / 3600 for a, b in zip(found, found[1:])]
        assert [r["gap_hours"] for r in found] == gaps


def test_hot_slices_are_split_without_changing_results(spark, monkeypatch):
    """Half of the hot video has one single time, some rows have none."""
    monkeypatch.setattr(ordering, "HOT_SLICE_ROWS", 50)
    monkeypatch.setattr(ordering, "HOT_SLICE_SHARE", 0.01)
    monkeypatch.setattr(ordering, "SLICE_CUTS", 16)
    df = big(spark).withColumn("timestamp", F.when(F.col("comment_id") % 2 == 0, F.lit(at(1, 3))).otherwise(F.col("timestamp")))
    parts = ordering._split_hot_slices(df.withColumn("__slice", ordering._hour_slice("timestamp")), "timestamp", "comment_id")
    sizes = parts.groupBy("video_id", "__slice", "__part").count()
    assert sizes.filter("video_id = 'hot' and __slice = '2024-01-01 03'").count() > 8
    found = ordering.row_number_per_video(df, "n").filter("video_id = 'hot'").collect()
    found.sort(key=lambda r: (r["timestamp"] is not None, r["timestamp"], r["comment_id"]))
    assert [r["n"] for r in found] == list(range(1, len(found) + 1))
    assert len(found) == df.filter("video_id = 'hot'").count()


def test_batches_keep_rows_without_time(spark):
    df = big(spark, 1000)
    batches = ordering.moderation_batches(df).collect()
    sizes = Counter((r["video_id"], r["batch_no"]) for r in batches)
    assert len(batches) == 1000 and max(sizes.values()) == 10
    assert len({(r["video_id"], r["batch_no"], r["comment_no"]) for r in batches}) == 1000


def test_pages(spark, monkeypatch):
    df = big(spark).filter("timestamp is not null")
    newest = sorted((r for r in df.collect() if r["video_id"] == "hot"), key=lambda r: r["comment_id"])
    newest.sort(key=lambda r: r["timestamp"], reverse=True)
    page = [r for r in ordering.comments_page(df, 3, 20).collect() if r["video_id"] == "hot"]
    assert {r["comment_id"] for r in page} == {r["comment_id"] for r in newest[40:60]}
    assert page[0]["total"] == len(newest) and page[0]["total_pages"] == -(-len(newest) // 20)
    deep = [r for r in ordering.comments_page(df, 30, 50).collect() if r["video_id"] == "hot"]
    assert {r["comment_id"] for r in deep} == {r["comment_id"] for r in newest[1450:1500]}
    monkeypatch.setattr(ordering, "HOT_SLICE_ROWS", 50)
    monkeypatch.setattr(ordering, "HOT_SLICE_SHARE", 0.001)
    split = ordering.comments_page(df, 30, 50)
    assert {r["comment_id"] for r in split.collect() if r["video_id"] == "hot"} == {r["comment_id"] for r in deep}
    last = newest[39]
    after = ordering.comments_after(df, "hot", F.lit(last["timestamp"]), F.lit(last["comment_id"]), 20)
    assert [r["comment_id"] for r in after.collect()] == [r["comment_id"] for r in newest[40:60]]


def test_statistics_document_and_report(spark, table):
    document = video_stats.comment_stats_document(sample(table)).persist()
    doc = {r["video_id"]: r for r in document.collect()}["v"]
    assert doc["classification_breakdown"] == {"safe:positive": 1, "toxic:negative": 1}
    assert [a["author"] for a in doc["top_commenters"]] == ["al", "bo"]
    assert [k["keyword"] for k in doc["top_keywords"]][:2] == ["good", "bad"]
    assert len(doc["sample_comments"]) == 4
    long = report_long(document)
    assert rows(long.filter("video_id = 'w' and section = 'Moderation Actions'"), "key", "value") == [(None, "No data available")]
    reports = report_text(document, F.lit("2024-02-01 00:00:00"))
    text = {r["video_id"]: r["report"] for r in reports.collect()}["v"]
    assert "## Classification Breakdown\n- safe:positive: 1\n- toxic:negative: 1\n" in text
    assert "- response_rate: 25.0" in text and '  Text: "a bad Day_1"' in text
    folder = scratch_dir(spark, "report")
    write_reports(reports, folder)
    assert spark.read.text(folder).filter("video_id = 'w'").count() > 10
    assert "Keywords:\n" in video_stats.summary_prompts(document).first()["prompt"]


def test_overall_statistics_are_not_double_counted(table):
    got = {r["video_id"]: r for r in video_stats.comment_stats(sample(table)).collect()}
    assert got[None]["total_comments"] == 6 and got[None]["unique_authors"] == 3
    assert got[None]["first_comment"] == at(1, 10) and got[None]["last_comment"] == at(3, 6)
    assert got[None]["total_word_count"] == sum(r["total_word_count"] for v, r in got.items() if v)


def test_analysis_summary(table):
    got = {r["video_id"]: r for r in video_stats.analysis_summary(sample(table)).collect()}["v"]
    assert got["classifications"] == '{"":1,"null":1,"safe:positive":1,"toxic:negative":1}'
    assert got["top_keywords"].startswith('{"good":2,"bad":1,')
