"""Moderation in batches by an external text model: prompts out, replies in, decisions applied."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from threadwise.operators.merge import apply_updates
from threadwise.operators.ordering import top_per_group

BATCH = ["video_id", "batch_no"]

INSTRUCTIONS = """
Classify every comment above as positive, negative, neutral, spam or offensive, choose one action
(allow, flag or remove) and give a short reason. Judge all comments by the same standard.
Answer in exactly this form for each comment:
Comment 1:
- Classification: <class>
- Action: <action>
- Reason: <reason>"""

# A reply function gets prompts and returns replies; its maker runs once per task, so a model loads once there.
ReplyMaker = Callable[[], Callable[[pd.Series], pd.Series]]


def moderation_prompts(batches: DataFrame) -> DataFrame:
    """One prompt per batch. A batch has a fixed number of rows, so the collected list is small."""
    line = F.concat(F.lit("Comment "), F.col("comment_no").cast("string"), F.lit(": "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("comment_no", line.alias("line"))))
    prompt = F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n" + INSTRUCTIONS))
    return batches.groupBy(*BATCH).agg(F.count("*").alias("batch_rows"), prompt.alias("prompt"))


def call_scorer(prompts: DataFrame, maker: ReplyMaker, prompt: str = "prompt", tasks: int | None = None) -> DataFrame:
    """Replace the prompt column by the reply of a user function, with the error of a batch that failed.

    Calls are slow, so the prompts are dealt out evenly over `tasks` (by default the shuffle partitions). A prompt
    whose call raises has no reply and the others go on.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reply = maker()

        def answer(text: str) -> tuple[str | None, str | None]:
            try:
                return reply(pd.Series([text])).iloc[0], None
            except Exception as error:  # whatever the user's model raises ends its batch only
                return None, f"{type(error).__name__}: {error}"

        for part in parts:
            found = [answer(text) for text in part[prompt]]
            yield part.assign(reply=[r for r, _ in found], error=[e for _, e in found]).drop(columns=prompt)

    fields = [f for f in prompts.schema.fields if f.name != prompt]
    added = [T.StructField(name, T.StringType()) for name in ("reply", "error")]
    spread = prompts.repartition(tasks or int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInPandas(run, T.StructType([*fields, *added]))


def call_outcomes(replies: DataFrame) -> DataFrame:
    """Batches answered and failed."""
    return replies.agg(F.count_if(F.col("error").isNull()).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def parse_moderation(replies: DataFrame) -> DataFrame:
    """Decisions in model replies (video_id, batch_no, batch_rows, reply).

    A block opens with "Comment n:" and counts only with n inside the batch and all three fields present;
    the last block of a comment wins. A reason may hold colons.
    """
    blocks = F.split("reply", r"(?m)^Comment (?=\d+:)")
    opened = replies.select(*BATCH, "batch_rows", F.posexplode(blocks).alias("block_no", "block")).filter("block_no > 0")

    def field(name: str):
        found = F.trim(F.regexp_extract("block", rf"(?m)^[ \t]*- {name}:(.*)$", 1))
        return F.nullif(found, F.lit(""))

    parsed = opened.select(
        *BATCH, "batch_rows", "block_no",
        F.regexp_extract("block", r"^(\d+):", 1).try_cast("bigint").alias("comment_no"),
        F.lower(field("Classification")).alias("classification"),
        F.lower(field("Action")).alias("mod_action"),
        field("Reason").alias("reason"),
    )
    valid = parsed.filter("comment_no between 1 and batch_rows").dropna(subset=["classification", "mod_action", "reason"])
    last = top_per_group(valid, [*BATCH, "comment_no"], [F.desc("block_no")], 1)
    return last.drop("block_no", "batch_rows")


def apply_moderation(comments: DataFrame, batches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Comments with the decisions of their batch; comments of a batch without reply stay as they are."""
    keys = [*BATCH, "comment_no"]
    updates = batches.select("comment_id", *keys).join(decisions, keys).drop(*keys)
    return apply_updates(comments, updates, "comment_id")
