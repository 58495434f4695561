"""Bucketed store, page directory and daily states: what they read, and what is left after a crash."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import at, rows
from threadwise.plans import states
from threadwise.session import scratch_dir
from threadwise.sources import buckets, pages

SCHEMA = "comment_id STRING, likes BIGINT, author STRING"


@pytest.fixture
def store(spark, table):
    path = scratch_dir(spark, "store")
    buckets.create_store(table(SCHEMA, [(str(i), i, "a") for i in range(200)]), path, "comment_id", 8)
    return path


def files_read(df):
    """Rows of a table, and how many files its scans read."""
    found = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    plans = [leaves.apply(i) for i in range(leaves.size())]
    final = [p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p for p in plans]
    metrics = [m.metrics() for m in final]
    return found, sum(m.apply("numFiles").value() for m in metrics if m.contains("numFiles"))


def test_updates_rewrite_the_touched_buckets_only(spark, table, store):
    before = buckets.manifest(spark, store, 0)
    changes = table("comment_id STRING, likes BIGINT, seq INT", [("7", 70, 1), ("7", 71, 2), ("9", None, 1), ("none", 5, 1)])
    assert buckets.change_store(spark, store, SCHEMA, changes, "comment_id", [F.desc("seq")]) == 1
    got = {r["comment_id"]: (r["likes"], r["author"]) for r in buckets.read_store(spark, store, SCHEMA).collect()}
    assert got == {str(i): (71 if i == 7 else i, "a") for i in range(200)}
    touched = {r[0] for r in changes.select(buckets.bucket_of("comment_id", 8)).distinct().collect()}
    after = buckets.manifest(spark, store, 1)
    assert {b for b in after if after[b] != before[b]} == touched and len(touched) < 8
    # The version before stays as it was.
    assert buckets.read_store(spark, store, SCHEMA, 0).filter("comment_id = '7'").first()["likes"] == 7


def test_inserts_replace_whole_rows_and_null_keys(spark, table, store):
    first = table("comment_id STRING, likes BIGINT", [("3", 33), (None, 1), ("new", 2)])
    buckets.change_store(spark, store, SCHEMA, first, "comment_id", [], insert=True)
    buckets.change_store(spark, store, SCHEMA, table("comment_id STRING, likes BIGINT", [(None, 8)]), "comment_id", [], insert=True)
    got = buckets.read_store(spark, store, SCHEMA)
    assert got.count() == 202
    assert rows(got.filter("comment_id is null or comment_id in ('3', 'new')")) == [(None, 8, None), ("3", 33, None), ("new", 2, None)]
    assert buckets.versions(spark, store) == [0, 1, 2]
    assert buckets.change_store(spark, store, SCHEMA, first.limit(0), "comment_id", [], insert=True) == 2


def test_stored_rows_are_not_shuffled(spark, table, store, monkeypatch):
    plans = []
    write = buckets._write
    monkeypatch.setattr(buckets, "_write", lambda df, path, folder: [
        plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, path, folder)] and None)
    changes = table("comment_id STRING, likes BIGINT", [(str(i), -i) for i in range(0, 200, 3)])
    buckets.change_store(spark, store, SCHEMA, changes, "comment_id", [], most=30)
    assert len(plans) > 1  # groups of buckets
    for plan in plans:
        stored_side = plan[:plan.index("BroadcastExchange")]
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in stored_side and "SortMergeJoin" not in plan
    got = {r["comment_id"]: r["likes"] for r in buckets.read_store(spark, store, SCHEMA).collect()}
    assert got == {str(i): -i if i % 3 == 0 else i for i in range(200)}


def test_a_bucket_with_more_changes_than_may_be_sent_is_joined_all_the_same(spark, table, store):
    changes = table("comment_id STRING, likes BIGINT", [(str(i), -1) for i in range(200)])
    buckets.change_store(spark, store, SCHEMA, changes, "comment_id", [], most=3)
    assert buckets.read_store(spark, store, SCHEMA).filter("likes = -1").count() == 200


def test_groups_of_buckets_are_bounded():
    assert buckets.grouped({0: 4, 1: 4, 2: 9, 3: 1, 4: 1}, 8) == [[0, 1], [2], [3, 4]]
    assert buckets.grouped({}, 8) == []


@pytest.mark.parametrize("where", ["_write", "_publish"])
def test_a_crash_leaves_the_version_before(spark, table, store, monkeypatch, where):
    changes = table("comment_id STRING, likes BIGINT", [(str(i), -1) for i in range(200)])
    real, calls = getattr(buckets, where), []

    def failing(*args):
        calls.append(args)
        if where == "_publish" or len(calls) == 2:
            raise OSError("the driver is gone")
        real(*args)

    monkeypatch.setattr(buckets, where, failing)
    with pytest.raises(OSError):
        buckets.change_store(spark, store, SCHEMA, changes, "comment_id", [], most=60)
    assert buckets.versions(spark, store) == [0]
    assert buckets.read_store(spark, store, SCHEMA).filter("likes = -1").count() == 0
    monkeypatch.setattr(buckets, where, real)
    assert buckets.change_store(spark, store, SCHEMA, changes, "comment_id", [], most=60) == 1
    assert buckets.read_store(spark, store, SCHEMA).filter("likes = -1").count() == 200


# ---- pages

COMMENTS = "comment_id STRING, video_id STRING, timestamp TIMESTAMP_NTZ"


def test_pages_of_any_depth_are_those_of_a_sort(spark, table):
    rng = random.Random(2)
    made = [(f"{i:04}", rng.choice("vvvw"), at(rng.randint(1, 5), rng.choice([3, 3, 9]), rng.randint(0, 3))) for i in range(300)]
    made += [("x1", "v", None), ("x2", "v", None), ("y", None, at(1))]
    path = scratch_dir(spark, "pages")
    pages.store_with_directory(table(COMMENTS, made[:200]), path)
    pages.store_with_directory(table(COMMENTS, made[200:]), path)  # more rows of the same hours
    own = sorted([r for r in made if r[1] == "v"], key=lambda r: r[0])
    own = sorted([r for r in own if r[2]], key=lambda r: r[2], reverse=True) + [r for r in own if not r[2]]
    count = -(-len(own) // 7)
    for page in (1, 2, count // 2, count, count + 1):
        got = pages.stored_page(spark, path, COMMENTS, "v", page, 7).collect()
        assert [r["comment_id"] for r in got] == [r[0] for r in own[7 * (page - 1):7 * page]]
        assert all((r["total"], r["page"], r["total_pages"]) == (len(own), page, count) for r in got)
    assert pages.stored_page(spark, path, COMMENTS, "nothing", 1, 7).count() == 0


def test_a_page_reads_its_hours_only(spark, table):
    path = scratch_dir(spark, "pages")
    made = [(f"{d}-{h}-{i}", "v", at(d, h, i)) for d in range(1, 6) for h in range(4) for i in range(5)]
    pages.store_with_directory(table(COMMENTS, made).coalesce(1), path)
    found, read = files_read(pages.stored_page(spark, path, COMMENTS, "v", 9, 10).drop("total"))
    assert [r["comment_id"] for r in found][:2] == ["1-3-4", "1-3-3"] and len(found) == 10
    assert read == 2  # of twenty hours


# ---- states

EVENTS = ("comment_id STRING, video_id STRING, author STRING, timestamp TIMESTAMP_NTZ, likes BIGINT, classification STRING, "
          "content_class STRING, is_spam BOOLEAN, emotional_score DOUBLE, responded BOOLEAN")


def some_events(n, seed=1):
    rng = random.Random(seed)
    maybe = lambda x: x if rng.random() < 0.9 else None
    return [(str(i), maybe(rng.choice("vw")), maybe(f"u{rng.randint(0, n)}"), at(rng.randint(1, 6), rng.randint(0, 23)), maybe(i),
             maybe("c"), maybe(rng.choice(states.CLASSES)), maybe(rng.random() < 0.5), maybe(rng.uniform(-1, 1)), maybe(True))
            for i in range(n)]


def test_states_added_by_days_equal_a_full_run(spark, table):
    made = some_events(400)
    whole, by_day = scratch_dir(spark, "states"), scratch_dir(spark, "states")
    states.store_states(table(EVENTS, made), whole)
    for day in (3, 1, 6, 5, 4, 2, 5):  # the fifth day comes twice and counts once
        states.store_states(table(EVENTS, [r for r in made if r[3].day == day]), by_day)
    want, got = (rows(states.merged(spark, p, exact=True)) for p in (whole, by_day))
    assert got == want and len(got) == 3
    videos = {r["video_id"]: r for r in states.merged(spark, by_day, exact=True).collect()}
    for video, r in videos.items():
        own = [m for m in made if m[1] == video]
        assert (r["total"], r["likes"], r["scored"]) == (
            len(own), sum(m[4] or 0 for m in own), sum(m[8] is not None for m in own))
        assert r["distinct_authors"] == len({m[2] for m in own})
        assert r["class_spam"] == sum(m[6] == "spam" for m in own) and r["last_at"] == max(m[3] for m in own)
    since = states.merged(spark, by_day, since="2024-01-04").agg(F.sum("total")).first()[0]
    assert since == sum(m[3].day >= 4 for m in made)


def test_sketches_merge_within_their_error(spark, table):
    made = some_events(6000, seed=2)
    path = scratch_dir(spark, "states")
    for half in (made[:3000], made[3000:]):
        shifted = [(*m[:3], at(1 + (m in half and half is made[3000:]), 1), *m[4:]) for m in half]
        states.store_states(table(EVENTS, shifted), path)
    near, exact = ({r["video_id"]: r["distinct_authors"] for r in states.merged(spark, path, exact=e).collect()} for e in (0, 1))
    for video in exact:
        assert abs(near[video] - exact[video]) <= 4 * 1.04 / 2 ** (states.SKETCH_BITS / 2) * exact[video] + 1


def test_merging_reads_no_comments(spark, table):
    path = scratch_dir(spark, "states")
    states.store_states(table(EVENTS, some_events(50)), path)
    plan = states.merged(spark, path, since="2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and f"{path}/states" in plan.replace("file:", "") or "/states" in plan
    assert "hll_union_agg" in plan
