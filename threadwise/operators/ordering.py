"""Order-based operators: top-k, pages, row numbers and gaps within a video.

A video may hold a large part of all comments, so no window runs over a whole video. Row numbers and gaps are
computed inside (video, hour) slices, hot ones split further, and corrected with one summary row per slice.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadwise import constants as C
from threadwise.functions.times import hours_between
from threadwise.operators.joins import null_safe_join
from threadwise.session import checkpointed

SLICE = ["video_id", "__slice"]
PART = [*SLICE, "__part"]
HOT_SLICE_SHARE = 1 / 5000
HOT_SLICE_ROWS = 1_000_000
SLICE_CUTS = 128
# Spark's default for cutting groups before a window; larger ranks would sort a whole video in one task.
GROUP_LIMIT = 1000


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows of each group. Spark cuts each group to k rows before the shuffle (window group limit)."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def top_terms(df: DataFrame, term: str, k: int = C.TOP_KEYWORDS) -> DataFrame:
    """The k most frequent values of a column, ties in value order."""
    counts = df.groupBy(term).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), term).limit(k)


def _hour_slice(time: str) -> Column:
    return F.coalesce(F.substring(F.col(time).cast("string"), 1, 13), F.lit(""))


def _split_hot_slices(rows: DataFrame, time: str, tie: str, tie_down: bool = False) -> DataFrame:
    """Add the part of each row in its slice: 0, or for a hot slice the number of cut points up to the row.

    Cut points are different (time, tie) values of the slice chosen by their hash, so every evaluation finds the same
    ones, even rows of one single time are split, and copies of a row make one point. Hot slices hold more than HOT_SLICE_SHARE of all rows each, so the
    broadcast tables are bounded by 1 / HOT_SLICE_SHARE slices with about SLICE_CUTS points.
    """
    sizes = checkpointed(rows.groupBy(*SLICE).agg(F.count("*").alias("__size")))
    total = sizes.agg(F.sum("__size")).scalar()
    hot = sizes.filter((F.col("__size") >= HOT_SLICE_ROWS) & (F.col("__size") > total * F.lit(HOT_SLICE_SHARE)))
    point = F.struct(F.col(time).alias("time"), F.col(tie).alias("tie"))
    chosen = F.pmod(F.xxhash64(time, tie), F.col("__size")) < SLICE_CUTS
    cuts = (
        null_safe_join(rows.select(*SLICE, time, tie), F.broadcast(hot), SLICE, "inner").filter(chosen)
        .select(*SLICE, time, tie).distinct().groupBy(*SLICE).agg(F.collect_list(point).alias("__cuts"))
    )

    def up_to_row(cut: Column) -> Column:
        tied = cut["tie"] >= F.col(tie) if tie_down else cut["tie"] <= F.col(tie)
        return F.coalesce(cut["time"] < F.col(time), F.lit(False)) | (cut["time"].eqNullSafe(F.col(time)) & tied)

    part = F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", up_to_row)))
    return null_safe_join(rows, F.broadcast(cuts), SLICE, "left").withColumn("__part", part).drop("__cuts")


def _sliced(df: DataFrame, time: str, tie: str, tie_down: bool = False) -> DataFrame:
    """Rows with their place in the slice, and of the slices before: the row count and the last time."""
    rows = _split_hot_slices(df.withColumn("__slice", _hour_slice(time)), time, tie, tie_down)
    slices = rows.groupBy(*PART).agg(F.count("*").alias("__rows"), F.max(time).alias("__last"))
    earlier = Window.partitionBy("video_id").orderBy("__slice", "__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *PART,
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
        F.max("__last").over(earlier).alias("__previous"),
    )
    in_part = Window.partitionBy(*PART).orderBy(time, F.desc(tie) if tie_down else F.asc(tie))
    placed = rows.withColumns({
        "__place": F.row_number().over(in_part),
        "__lag": F.lag(time).over(in_part),
    })
    return null_safe_join(placed, offsets, PART, "inner")


def row_number_per_video(df: DataFrame, name: str, time: str = "timestamp", tie: str = "comment_id",
                         tie_down: bool = False) -> DataFrame:
    """Number the comments of each video from 1 in time order, equal times by the tie column."""
    placed = _sliced(df, time, tie, tie_down).withColumn(name, (F.col("__before") + F.col("__place")).cast("bigint"))
    return placed.select(*df.columns, name)


def comment_gaps(df: DataFrame, time: str = "timestamp", tie: str = "comment_id") -> DataFrame:
    """Hours since the previous comment of the video; NULL for its first."""
    previous = F.coalesce("__lag", "__previous")
    placed = _sliced(df, time, tie).withColumn("gap_hours", hours_between(previous, F.col(time)))
    return placed.select(*df.columns, "gap_hours")


def comments_page(comments: DataFrame, page: int = 1, per_page: int = C.PAGE_SIZE) -> DataFrame:
    """One page of every video, newest first, with the video's total and number of pages.

    Early pages are cut to size before the shuffle; later ones count back from the oldest comment in slices.
    """
    totals = comments.groupBy("video_id").agg(F.count("*").alias("total"))
    if page * per_page <= GROUP_LIMIT:
        order = [F.desc("timestamp"), F.col("comment_id")]
        numbered = top_per_group(comments, ["video_id"], order, page * per_page, "__n")
        numbered = null_safe_join(numbered, totals, ["video_id"], "inner")
    else:
        oldest_first = null_safe_join(
            row_number_per_video(comments, "__n", tie_down=True), totals, ["video_id"], "inner")
        numbered = oldest_first.withColumn("__n", F.col("total") - F.col("__n") + 1)
    return (
        numbered.filter((F.col("__n") > (page - 1) * per_page) & (F.col("__n") <= page * per_page))
        .withColumns({
            "page": F.lit(page).cast("bigint"),
            "per_page": F.lit(per_page).cast("bigint"),
            "total_pages": F.ceil(F.col("total") / per_page).cast("bigint"),
        })
        .drop("__n")
    )


def comments_after(comments: DataFrame, video_id: str, last_time: Column, last_id: Column,
                   per_page: int = C.PAGE_SIZE) -> DataFrame:
    """The page of one video that follows a given row: constant cost at any depth."""
    later = (F.col("timestamp") < last_time) | ((F.col("timestamp") == last_time) & (F.col("comment_id") > last_id))
    rows = comments.filter((F.col("video_id") == video_id) & later)
    return rows.orderBy(F.desc("timestamp"), "comment_id").limit(per_page)


def moderation_batches(queue: DataFrame, batch_size: int = C.MODERATION_BATCH) -> DataFrame:
    """Split the queue of each video in numbered batches, rows numbered from 1 within a batch."""
    numbered = row_number_per_video(queue, "__n")
    return numbered.withColumns({
        "batch_no": F.ceil(F.col("__n") / batch_size).cast("bigint"),
        "comment_no": (F.pmod(F.col("__n") - 1, F.lit(batch_size)) + 1).cast("bigint"),
    }).drop("__n")
