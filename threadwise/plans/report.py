"""Statistics as long rows and as markdown reports."""

from pyspark.sql import Column, DataFrame, functions as F

from threadwise import constants as C


def _line(key: Column, value: Column) -> Column:
    return F.struct(key.cast("string").alias("key"), value.cast("string").alias("value"))


def _no_lines() -> Column:
    return F.array().cast("array<struct<key:string,value:string>>")


def _map_lines(column: str) -> Column:
    return F.coalesce(F.transform(F.map_entries(column), lambda e: _line(e["key"], e["value"])), _no_lines())


def _section_lines(name: str) -> Column:
    scalars = [_line(F.lit(c), F.col(c)) for c in C.REPORT_SECTIONS[name]]
    if name == "Classification Breakdown":
        return _map_lines("classification_breakdown")
    if name == "Moderation Actions":
        return _map_lines("mod_action_breakdown")
    if name == "Top Commenters":
        return F.coalesce(F.transform("top_commenters", lambda a: _line(a["author"], a["comment_count"])), _no_lines())
    if name == "Keyword Analysis":
        words = F.coalesce(F.transform("top_keywords", lambda k: _line(k["keyword"], k["n"])), _no_lines())
        return F.concat(words, F.array(*scalars))
    if name == "Emotional Analysis":
        return F.when(F.col("avg_emotional_score").isNull(), _no_lines()).otherwise(F.array(*scalars))
    return F.array(*scalars)


def _filled_lines(name: str) -> Column:
    """The lines of a section, or one that says there are none."""
    lines = _section_lines(name)
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(_line(F.lit(None), F.lit(C.REPORT_NO_DATA))))


def report_long(document: DataFrame) -> DataFrame:
    """Rows (video_id, section, line_no, key, value) of the statistics documents.

    A section without lines gets one row saying so.
    """
    sections = [
        F.struct(F.lit(number).alias("section_no"), F.lit(name).alias("section"), _filled_lines(name).alias("lines"))
        for number, name in enumerate(C.REPORT_SECTIONS, 1)
    ]
    exploded = document.select("video_id", F.explode(F.array(*sections)).alias("s"))
    return exploded.select(
        "video_id", F.col("s.section_no").cast("bigint").alias("section_no"), "s.section",
        F.posexplode("s.lines").alias("line_no", "line"),
    ).select("video_id", "section_no", "section", F.col("line_no").cast("bigint").alias("line_no"), "line.key", "line.value")


def report_text(document: DataFrame, generated: Column) -> DataFrame:
    """One markdown report per video, built in the row of its document: a fixed number of short lists, no shuffle."""
    def shown(line: Column) -> Column:
        pair = F.concat(F.lit("- "), line["key"], F.lit(": "), F.coalesce(line["value"], F.lit("None")))
        return F.when(line["key"].isNull(), line["value"]).otherwise(pair)

    blocks = [F.concat(F.lit(f"## {name}\n"), F.array_join(F.transform(_filled_lines(name), shown), "\n"))
              for name in C.REPORT_SECTIONS]
    samples = F.coalesce(F.array_join(F.transform("sample_comments", _sample_lines), "\n"), F.lit(""))
    head = F.concat(F.lit(f"{C.REPORT_TITLE}\n{C.REPORT_TIME}"), generated.cast("string"))
    return document.select("video_id", F.concat_ws(
        "\n\n", head, *blocks, F.concat(F.lit(f"{C.REPORT_SAMPLES}\n"), samples)).alias("report"))


def _sample_lines(sample: Column) -> Column:
    def line(name: str) -> Column:
        value = F.coalesce(sample[name].cast("string"), F.lit("None"))
        return F.concat(F.lit("\n" + C.SAMPLE_LINES[name]), F.concat(F.lit('"'), value, F.lit('"')) if name == "text" else value)

    return F.concat(*[line(name) for name in C.SAMPLE_LINES])


def write_reports(reports: DataFrame, path: str) -> None:
    """Write one folder of text per video."""
    reports.select("video_id", F.col("report").alias("value")).write.mode("overwrite").partitionBy("video_id").text(path)
