"""Rows without a video, repeated updates, copies in hot slices."""

from pyspark.sql import functions as F

from conftest import at, rows
from threadwise.operators import merge, ordering
from threadwise.session import scratch_dir
from threadwise.sources import api, tables

COMMENTS = "comment_id STRING, video_id STRING, timestamp TIMESTAMP_NTZ"


def test_rows_without_a_video_stay(table):
    df = table(COMMENTS, [("a", "v", at(1)), ("b", None, at(1)), ("c", None, at(1, 2)), ("d", None, None)])
    assert rows(ordering.comment_gaps(df), "comment_id", "gap_hours") == [("a", None), ("b", None), ("c", 2.0), ("d", None)]
    assert ordering.moderation_batches(df).count() == 4
    assert ordering.comments_page(df).count() == 4
    assert ordering.comments_page(df, page=2, per_page=1000).count() == 0


def test_a_copied_row_makes_one_cut_point(table, monkeypatch):
    monkeypatch.setattr(ordering, "HOT_SLICE_ROWS", 10)
    monkeypatch.setattr(ordering, "HOT_SLICE_SHARE", 0.0)
    df = table(COMMENTS, [("a", "v", at(1))] * 500 + [(str(i), "v", at(1, 0, i % 60)) for i in range(500)])
    sliced = ordering._split_hot_slices(df.withColumn("__slice", ordering._hour_slice("timestamp")), "timestamp", "comment_id")
    assert 2 <= sliced.select("__part").distinct().count() <= 2 * ordering.SLICE_CUTS
    assert rows(ordering.row_number_per_video(df, "n"), "n") == [(i + 1,) for i in range(1000)]


def test_one_update_of_a_key_counts(table):
    target = table("k STRING, x BIGINT, y STRING", [("a", 1, "p"), ("b", 2, "q"), (None, 3, "r")])
    updates = table("k STRING, x BIGINT, seq BIGINT", [("a", 10, 1), ("a", 11, 2), ("a", 9, 0)])
    got = merge.apply_updates(target.withColumn("seq", F.lit(0).cast("bigint")), updates, "k", "seq")
    assert rows(got, "k", "x") == [(None, 3), ("a", 11), ("b", 2)]
    assert merge.apply_updates(target, updates.drop("seq"), "k").count() == 3


def test_updates_reach_rows_without_a_partition(spark, table):
    schema, folder = "k STRING, x BIGINT, p STRING", scratch_dir(spark, "null")
    table(schema, [("a", 1, None), ("b", 2, None), ("c", 3, "q")]).write.partitionBy("p").parquet(folder)
    tables.update_stored(spark, folder, schema, table("k STRING, x BIGINT", [("a", 7)]), "k", "p")
    assert rows(tables.scan_table(spark, folder, schema)) == [("a", 7, None), ("b", 2, None), ("c", 3, "q")]


def test_new_rows_are_the_ones_to_append(table):
    target = table("k STRING, x BIGINT", [("a", 1), (None, 2)])
    batch = table("k STRING, x BIGINT", [("a", 5), ("b", 6), ("b", 7), (None, 8)])
    assert rows(merge.new_rows(target, batch, "k", [F.col("x")])) == [("b", 6)]


def test_every_video_of_a_document_gives_a_row(table):
    one = '{"request": {"videoId": "v"}, "items": [{"id": "v1", "snippet": {"title": "t"}}, {"id": "v2", "snippet": {"title": "u"}}, {"snippet": {}}, {"id": "x"}]}'
    got = rows(api.ingest_videos(table("json STRING", [(one,)])), "video_id", "title")
    assert [k for k, _ in got] == ["v", "v1", "v2"]
