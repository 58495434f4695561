import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from threadwise.operators import merge, quality
from threadwise.schemas import COMMENTS, VIDEOS
from threadwise.session import checkpointed, scratch_dir
from threadwise.sources import api, tables


def documents(table, *docs):
    return table("json STRING", [(json.dumps(d),) for d in docs])


def load_time():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def comment(text, **more):
    return {"textDisplay": text, "publishedAt": "2024-01-01T10:00:00Z", **more}


def test_threads_and_replies(table):
    reply = {"id": "r1", "snippet": comment("re", authorDisplayName="bo", likeCount=3)}
    docs = documents(table, {"request": {"videoId": "v"}, "items": [
        {"id": "t1", "snippet": {"totalReplyCount": 1, "topLevelComment": {"snippet": comment("hi", authorDisplayName="al")}},
         "replies": {"comments": [reply]}},
        {"id": "t2", "snippet": {"topLevelComment": {"snippet": {}}}},
        {"id": "t3", "snippet": {"totalReplyCount": 0, "topLevelComment": {"snippet": comment("x")}}, "replies": {"comments": [reply]}},
        {"id": "t4", "snippet": {"totalReplyCount": 2}},
    ]}, {"request": {"videoId": "w"}, "items": []}, {"request": {"videoId": "w"}})
    got = rows(api.ingest_comments(docs, load_time()), "comment_id", "video_id", "parent_id", "author", "text", "likes", "reply_count", "timestamp")
    assert got == [
        ("r1", "v", "t1", "bo", "re", 3, 0, at(1, 10)),
        ("t1", "v", None, "al", "hi", 0, 1, at(1, 10)),
        ("t2", "v", None, "Unknown", "", 0, 0, at(1).replace(month=2)),
        ("t3", "v", None, "Unknown", "x", 0, 0, at(1, 10)),
    ]


def test_videos(table):
    docs = documents(
        table,
        {"request": {"videoId": "a"}, "items": [{"snippet": {"title": "T", "channelTitle": "C", "thumbnails": {"default": {"url": "u"}}}}]},
        {"request": {"videoId": "b"}, "items": [{"snippet": {}}]},
        {"request": {"videoId": "c"}, "items": []},
        {"request": {"videoId": "d"}, "items": [{}]},
    )
    assert rows(api.ingest_videos(docs)) == [("a", "T", "C", "u"), ("b", "Unknown Title", "Unknown Channel", None)]


KEYED = "comment_id STRING, video_id STRING, likes BIGINT"


def test_insert_keeps_stored_then_first(table):
    target = table(KEYED, [("a", "v", 1)])
    batch = table(KEYED + ", seq INT", [("a", "v", 9, 1), ("b", "v", 2, 2), ("b", "v", 1, 1)])
    assert rows(merge.insert_if_absent(target, batch, "comment_id", [F.col("seq")])) == [("a", "v", 1), ("b", "v", 1)]
    assert rows(merge.ingest_counts(target, batch, "comment_id", "video_id")) == [("v", 3, 1, 2)]


def test_upsert_replaces_whole_rows(table):
    target = table("video_id STRING, title STRING, thumbnail_url STRING, seq INT", [("a", "old", "u", 5), ("b", "kept", "w", 5)])
    batch = table("video_id STRING, title STRING, seq INT", [("a", "new", 2), ("a", "newer", 3)])
    assert rows(merge.upsert_latest(target, batch, "video_id", "seq"), "video_id", "title", "thumbnail_url") == [
        ("a", "newer", None), ("b", "kept", "w")]


def test_updates_change_only_given_values(table):
    target = table(KEYED, [("a", "v", 1), ("b", "v", 2)])
    updates = table("comment_id STRING, likes BIGINT", [("a", 7), ("b", None), ("c", 1)])
    assert rows(merge.apply_updates(target, updates, "comment_id")) == [("a", "v", 7), ("b", "v", 2)]


def test_evolve_schema(table):
    old = table("comment_id STRING, video_id STRING, likes INT, seq INT, gone STRING", [("a", "v", None, 2, "x"), ("a", "w", 3, 1, "x")])
    new = merge.evolve_schema(old, COMMENTS, "comment_id", [F.col("seq")], {"likes": F.lit(0), "reply_count": F.lit(0)})
    assert "gone" not in new.columns and len(new.columns) == 23
    assert rows(new, "comment_id", "video_id", "likes", "reply_count", "spam_score") == [("a", "w", 3, 0, None)]


def test_partition_replacement_and_scan(spark, table):
    folder = scratch_dir(spark, "test") + "/t"
    df = table(KEYED, [("a", "v", 1), ("b", "w", 2)])
    df.write.partitionBy("video_id").parquet(folder)
    tables.replace_partitions(table(KEYED, [("a", "v", 5)]), folder, "video_id")
    schema = KEYED + ", spam_score DOUBLE"
    assert rows(tables.scan_table(spark, folder, schema), "comment_id", "likes", "spam_score") == [("a", 5, None), ("b", 2, None)]
    tables.append_rows(df.select("comment_id"), scratch_dir(spark, "test") + "/u")
    assert ("video_id", "string") in tables.table_columns(df)


def test_update_rewrites_only_touched_partitions(spark, table):
    folder = scratch_dir(spark, "update") + "/t"
    df = table(KEYED, [("a", "v", 1), ("b", "v", 2), ("c", "w", 3)])
    df.coalesce(1).write.partitionBy("video_id").parquet(folder)
    files = lambda: {r[0] for r in spark.read.parquet(folder).select(F.input_file_name()).distinct().collect()}
    before = files()
    tables.update_stored(spark, folder, KEYED, table("comment_id STRING, likes BIGINT", [("a", 9), ("zz", 1)]), "comment_id", "video_id")
    assert rows(tables.scan_table(spark, folder, KEYED), "comment_id", "video_id", "likes") == [("a", "v", 9), ("b", "v", 2), ("c", "w", 3)]
    assert [f for f in before & files() if "video_id=w" in f] and not [f for f in before & files() if "video_id=v" in f]


def test_day_folders_are_pruned(spark, table):
    folder = scratch_dir(spark, "days")
    ddl = "comment_id STRING, timestamp TIMESTAMP_NTZ"
    tables.store_by_day(table(ddl, [("a", at(1, 5)), ("b", at(2, 5)), ("c", at(2, 7)), ("n", None)]), folder)
    recent = tables.scan_since(spark, folder, ddl, F.lit(at(2, 6)))
    assert rows(recent, "comment_id") == [("c",)]
    assert "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().executedPlan().toString()
    assert scan_all(spark, folder, ddl) == 4


def scan_all(spark, folder, ddl):
    return tables.scan_table(spark, folder, ddl + ", day DATE").count()


def test_declared_schemas_parse(spark):
    for ddl in (COMMENTS, VIDEOS):
        assert spark.createDataFrame([], ddl).columns


def test_checkpoint_is_reliable(spark, table):
    assert rows(checkpointed(table("x INT", [(1,)]))) == [(1,)]
    assert spark.sparkContext.getCheckpointDir()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    def session(shared):
        conf = SimpleNamespace(get=lambda key, default: shared)
        own = spark.sparkContext
        context = SimpleNamespace(master="yarn", _jvm=own._jvm, _jsc=own._jsc, applicationId=own.applicationId)
        return SimpleNamespace(conf=conf, sparkContext=context)

    with pytest.raises(ValueError):
        scratch_dir(session(None), "x")
    assert scratch_dir(session(f"file://{tmp_path}/"), "x").startswith(f"file://{tmp_path}/threadwise-{spark.sparkContext.applicationId}/x-")


def test_quality(table):
    comments = table("comment_id STRING, video_id STRING, parent_id STRING", [("a", "v", None), ("b", "v", "a"), ("c", "w", "zz"), ("c", "w", None)])
    videos = table("video_id STRING", [("v",)])
    assert rows(quality.orphan_rows(comments, "video_id", videos, "video_id", "comment_id"), "comment_id", "video_id") == [("c", "w"), ("c", "w")]
    assert rows(quality.orphan_rows(comments, "parent_id", comments, "comment_id", "comment_id"), "comment_id", "parent_id") == [("c", "zz")]
    assert rows(quality.duplicate_keys(comments, "comment_id")) == [("c", 2)]
    assert rows(quality.null_violations(comments, ["comment_id", "parent_id"])) == [("comment_id", 0), ("parent_id", 2)]
