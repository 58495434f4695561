from conftest import at, rows
from threadwise.operators import moderation as M
from threadwise.operators.ordering import moderation_batches

REPLIES = "video_id STRING, batch_no BIGINT, batch_rows BIGINT, reply STRING"


def block(n, *lines):
    return "\n".join([f"Comment {n}:", *lines])


def parsed(table, reply, size=3):
    return rows(M.parse_moderation(table(REPLIES, [("v", 1, size, reply)])), "comment_no", "classification", "mod_action", "reason")


def test_strict_blocks(table):
    reply = "\n".join([
        "Sure, here it is. - Classification: none",
        block(1, "- Classification: Spam", "- Action: REMOVE", "- Reason: link: buy: now"),
        block(2, "- Classification: neutral", "- Reason: no action given"),
        block(0, "- Classification: a", "- Action: b", "- Reason: c"),
        block(4, "- Classification: a", "- Action: b", "- Reason: c"),
        block(3, "  - Classification:  positive ", "  - Action: allow", "  - Reason:  fine "),
    ])
    assert parsed(table, reply) == [(1, "spam", "remove", "link: buy: now"), (3, "positive", "allow", "fine")]


def test_last_block_of_a_comment_wins_and_noise_is_ignored(table):
    full = ["- Classification: a", "- Action: b"]
    assert parsed(table, block(1, *full, "- Reason: x") + "\n" + block(1, *full, "- Reason: y")) == [(1, "a", "b", "y")]
    assert parsed(table, "no blocks") == [] and parsed(table, None) == []
    assert parsed(table, block("99999999999999999999", *full, "- Reason: x")) == []


def test_prompt_call_and_apply(table):
    comments = table("comment_id STRING, video_id STRING, timestamp TIMESTAMP_NTZ, text STRING, classification STRING, mod_action STRING, reason STRING",
                     [(f"{i:02d}", "v", at(1, i), f"text {i}", None, None, None) for i in range(12)])
    batches = moderation_batches(comments)
    prompts = M.moderation_prompts(batches)
    first = prompts.filter("batch_no = 1").first()
    assert first["batch_rows"] == 10 and first["prompt"].startswith("Comment 1: text 0\nComment 2: text 1\n")

    good = block(2, "- Classification: spam", "- Action: remove", "- Reason: ad")

    def maker():
        def reply(prompts):
            return prompts.map(lambda p: good if "text 10" in p else "cannot help")
        return reply

    decisions = M.parse_moderation(M.call_scorer(prompts, maker))
    moderated = M.apply_moderation(comments, batches, decisions)
    assert moderated.count() == 12
    assert rows(moderated.filter("classification is not null"), "comment_id", "classification", "mod_action", "reason") == [("11", "spam", "remove", "ad")]


def test_a_failing_batch_costs_itself_only(table):
    prompts = table("video_id STRING, batch_no BIGINT, batch_rows BIGINT, prompt STRING",
                    [("v", i, 1, "bad" if i == 2 else "Comment 1: x") for i in range(1, 5)])

    good = block(1, "- Classification: a", "- Action: b", "- Reason: c")

    def maker():
        def reply(prompts):
            return prompts.map(lambda p: good if p != "bad" else 1 / 0)
        return reply

    replies = M.call_scorer(prompts, maker)
    assert rows(M.parse_moderation(replies), "batch_no") == [(1,), (3,), (4,)]
    assert rows(M.call_outcomes(replies)) == [(3, 1)]
    assert replies.filter("error is not null").first()["error"].startswith("ZeroDivisionError")
