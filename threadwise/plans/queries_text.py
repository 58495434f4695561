"""Queries: text features, labels, sentiment, analysis and moderation (sections 2.8 and 2.10 of the survey)."""

from pyspark.sql import functions as F

from threadwise.functions import labels, text
from threadwise.operators import ledger, moderation, ordering, sentiment
from threadwise.operators.filters import unclassified
from threadwise.plans import analyze, video_stats
from threadwise.plans.catalog import query
from threadwise.session import checkpointed, scratch_dir
from threadwise.plans.oracle_text import FEATURES_SQL, INDICATORS_SQL, RATIO_SQL, SPACE, VERDICT_SQL, WHITELIST_SQL, sql_list


def _named(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} as {name}" for name, sql in columns.items())


def _rounded(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


@query(["comments_doc"], f"select comment_id, {_named(FEATURES_SQL)} from comments_doc")
def text_features(q):
    features = text.text_features(q("comments_doc").select("comment_id", "text"))
    ratios = [c for c in text.FEATURES if c.endswith("ratio") or c.startswith("avg")]
    return features.drop("text").withColumns(_rounded(*ratios))


@query(["comments_doc"], f"select comment_id, {_named(RATIO_SQL)} from comments_doc")
def spam_word_ratio(q):
    ratio = text.spam_word_ratio(q("comments_doc").select("comment_id", "text"))
    return ratio.drop("text").withColumns(_rounded("spam_word_ratio"))


@query(["comments_doc"], f"""
select comment_id, {WHITELIST_SQL} as whitelisted, case when {WHITELIST_SQL} then false end as is_spam,
       case when {WHITELIST_SQL} then cast(0.9 as double) end as confidence,
       case when {WHITELIST_SQL} then cast(0.1 as double) end as spam_score from comments_doc""")
def whitelist_match(q):
    verdict = text.spam_verdict(q("comments_doc").select("comment_id", "text", F.lit(None).alias("p")))
    friendly = F.col("whitelist_match")
    return verdict.select("comment_id", friendly.alias("whitelisted"),
                          *[F.when(friendly, F.col(c)).alias(c) for c in ("is_spam", "confidence", "spam_score")])


@query(["comments_doc"], f"""
select comment_id, {_named({**INDICATORS_SQL, 'all_caps_ratio': f"round({INDICATORS_SQL['all_caps_ratio']}, 6)"})}
from comments_doc""")
def spam_indicators(q):
    flags = text.spam_indicators(q("comments_doc").select("comment_id", "text"))
    return flags.drop("text").withColumns(_rounded("all_caps_ratio"))


LABEL_SQL = ("case when {c} > cast(0.05 as double) then 'positive' when {c} < cast(-0.05 as double) then 'negative' "
             "else 'neutral' end")
CLASS_SQL = ("case when {s} >= cast(0.85 as double) then 'spam' when {t} >= cast(0.8 as double) then 'toxic' "
             "when {t} >= cast(0.5 as double) or {s} >= cast(0.6 as double) then 'questionable' else 'safe' end")


@query(["model_scores"], f"select comment_id, {LABEL_SQL.format(c='compound')} as sentiment from model_scores")
def sentiment_label(q):
    return q("model_scores").select("comment_id", labels.sentiment_label(F.col("compound")).alias("sentiment"))


def _toxicity(q):
    """The three label scores of each comment as a (label, score) list."""
    scores = q("model_scores")
    entries = [F.struct(F.lit(n).alias("label"), F.col(n).alias("score")) for n in ("toxic", "insult", "threat")]
    return scores.withColumn("toxicity", F.array(*entries))


TOP_SQL = "case when toxic >= insult and toxic >= threat then 'toxic' when insult >= threat then 'insult' else 'threat' end"


@query(["model_scores"], f"""
select comment_id, {TOP_SQL} as main_category, greatest(toxic, insult, threat) as toxicity_score,
       concat_ws(',', case when toxic > cast(0.3 as double) and {TOP_SQL} <> 'toxic' then 'toxic' end,
                 case when insult > cast(0.3 as double) and {TOP_SQL} <> 'insult' then 'insult' end,
                 case when threat > cast(0.3 as double) and {TOP_SQL} <> 'threat' then 'threat' end) as other_concerns
from model_scores""")
def toxicity_summary(q):
    summary = labels.toxicity_summary(_toxicity(q))
    names = F.array_join(F.transform("other_concerns", lambda e: e["label"]), ",")
    return summary.select("comment_id", "main_category", "toxicity_score", names.alias("other_concerns"))


@query(["model_scores"], f"select comment_id, {CLASS_SQL.format(s='p', t='toxic')} as content_class from model_scores")
def content_class(q):
    return q("model_scores").select("comment_id", labels.content_class(F.col("toxic"), F.col("p")).alias("content_class"))


@query(["model_scores"], f"""
select comment_id, {CLASS_SQL.format(s='p', t='toxic')} || ':' || {LABEL_SQL.format(c='compound')} as classification
from model_scores""")
def combined_class(q):
    content = labels.content_class(F.col("toxic"), F.col("p"))
    combined = labels.combined_class(content, labels.sentiment_label(F.col("compound")))
    return q("model_scores").select("comment_id", combined.alias("classification"))


@query(["comments_doc", "model_scores"], f"""
select comment_id, {_named(VERDICT_SQL)}, {WHITELIST_SQL} as whitelist_match
from comments_doc join model_scores using (comment_id)""")
def spam_verdict(q):
    scored = q("comments_doc").select("comment_id", "text").join(q("model_scores").select("comment_id", "p"), "comment_id")
    return text.spam_verdict(scored).drop("text", "p")


def _scored(q):
    return q("comments_doc").join(_toxicity(q).select("comment_id", "p", "toxicity", "compound"), "comment_id")


ANALYZED_SQL = f"""
verdicts as (
  select comment_id, compound, insult as insult_score, {FEATURES_SQL['word_count']} as feature_words,
         {FEATURES_SQL['url_count']} as feature_urls, greatest(toxic, insult, threat) as toxicity_score, {_named(VERDICT_SQL)}
  from (select comment_id, text from comments_doc where classification is null or spam_score is null)
  join model_scores using (comment_id)),
analyzed as (
  select comment_id, toxicity_score, spam_score, is_spam, confidence, compound as emotional_score, insult_score,
         feature_words, feature_urls,
         {LABEL_SQL.format(c='compound')} as sentiment, {CLASS_SQL.format(s='spam_score', t='toxicity_score')} as content_class
  from verdicts)"""


@query(["comments_doc", "model_scores"], f"""
with {ANALYZED_SQL}
select *, content_class || ':' || sentiment as classification, false as is_error from analyzed""")
def analyze_comments(q):
    results = analyze.analyze_queue(_scored(q))
    return results.select(
        "comment_id", "toxicity_score", "spam_score", "is_spam", "confidence", "emotional_score", "sentiment",
        "content_class", "classification", "is_error", F.col("toxicity_scores")["insult"].alias("insult_score"),
        F.col("spam_features.word_count").alias("feature_words"), F.col("spam_features.url_count").alias("feature_urls"))


@query(["comments_doc", "model_scores"], f"""
with {ANALYZED_SQL}
select c.comment_id, coalesce(c.classification, a.content_class || ':' || a.sentiment) as classification,
       coalesce(c.spam_score, a.spam_score) as spam_score, coalesce(c.is_spam, a.is_spam) as is_spam,
       coalesce(c.emotional_score, a.emotional_score) as emotional_score
from comments_doc c left join analyzed a on c.comment_id = a.comment_id""")
def analyzed_table(q):
    """The comment table after the results of the queue are written back."""
    updated = analyze.write_back(q("comments_doc"), analyze.analyze_queue(_scored(q)))
    return updated.select("comment_id", "classification", "spam_score", "is_spam", "emotional_score")


# ---- lexicon sentiment

EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
SENTIMENT_SQL = f"""
word_lists as (
  select comment_id, text, is_spam, [case when length(regexp_replace(w, '{EDGES}', '', 'g')) <= 2 then w
         else regexp_replace(w, '{EDGES}', '', 'g') end
         for w in regexp_extract_all(text, '{SPACE.replace('[', '[^', 1)}+') if length(w) > 1] as ws
  from comments_doc),
lexicon_all as (
  select word, round((good - bad) * 4 / cast(good + bad as double), 3) as valence from (
    select word, count(case when not is_spam then 1 end) as good, count(case when is_spam then 1 end) as bad
    from (select unnest(list_distinct([lower(w) for w in ws])) as word, is_spam from word_lists where is_spam is not null)
    group by word)),
own as (select * from lexicon_all where word not in ({sql_list(sentiment.BOOSTERS + sentiment.DAMPENERS)})),
described as (
  select *, len(ws) as n, list_position([lower(w) for w in ws], 'but') as but,
         len([w for w in ws if w = upper(w) and w <> lower(w)]) as ups,
         least({'length(text) - length(replace(text, chr(33), chr(32)[1:0]))'}, 4) * cast(0.292 as double)
         + case when qs <= 1 then 0 when qs <= 3 then qs * cast(0.18 as double) else cast(0.96 as double) end as marks
  from (select *, length(text) - length(replace(text, '?', '')) as qs from word_lists)),
placed as (
  select comment_id, marks, but, ups > 0 and ups < n as mixed, i as place, ws[i] as w, lower(ws[i]) as word,
         case when i > 1 then ws[i-1] end as b1, case when i > 2 then ws[i-2] end as b2, case when i > 3 then ws[i-3] end as b3,
         lower(ws[i+1]) as a1, lower(ws[i+2]) as a2
  from (select *, unnest(range(1, n + 1)) as i from described)),
v0 as (
  select p.*, valence + case when w = upper(w) and w <> lower(w) and mixed then sign(valence) * cast(0.733 as double) else 0 end as v
  from placed p left join own using (word)),
{{steps}}
worded as (
  select comment_id, marks, coalesce(v * case when but > 0 and place < but then cast(0.5 as double)
                                       when but > 0 and place > but then cast(1.5 as double) else 1 end, 0) as v from v3),
sums as (
  select comment_id, max(marks) as marks, sum(v) as total, sum(case when v > 0 then v + 1 else 0 end) as up,
         sum(case when v < 0 then 1 - v else 0 end) as down, count(case when v = 0 then 1 end) as flat
  from worded group by comment_id),
stressed as (
  select comment_id, flat, total + sign(total) * marks as total, up + case when up > down then marks else 0 end as up,
         down + case when down > up then marks else 0 end as down from sums)"""


def _step(n: int, factor: float) -> str:
    """Effect of the n-th word before, as one table expression."""
    word = f"b{n}"
    boosters, dampeners, negations = (sql_list(v) for v in (sentiment.BOOSTERS, sentiment.DAMPENERS, sentiment.NEGATIONS))
    amount = (f"(case when lower({word}) in ({boosters}) then cast(0.293 as double) when lower({word}) in ({dampeners}) "
              f"then cast(-0.293 as double) end + case when {word} = upper({word}) and {word} <> lower({word}) and mixed "
              f"then cast(0.733 as double) else 0 end) * cast({factor} as double)")
    return f"""
v{n} as (
  select * exclude (v, step), case when {word} is null or lower({word}) in (select word from lexicon_all) then v
         when lower({word}) in ({negations}) then (v + case when v < 0 then -step else step end) * cast(-0.74 as double)
         else v + case when v < 0 then -step else step end end as v
  from (select *, coalesce({amount}, 0) as step from v{n - 1})),"""


SENTIMENT_SQL = SENTIMENT_SQL.replace("chr(33), chr(32)[1:0]", "'!', ''")
STEPS_SQL = "".join(_step(n, f) for n, f in ((1, 1.0), (2, 0.95), (3, 0.9)))

#: Phrases of the invented texts beside published ones, with made-up valences.
SOME_PHRASES = sentiment.Phrases({"to die for": 3.0, "of the": 2.0, "the and": -1.5, "the the the": 0.5, "is the": 0.0},
                                 ["kind of", "and the", "in the"])
PHRASE_VALUES_SQL = "(values ('to die for', 3.0), ('of the', 2.0), ('the and', -1.5), ('the the the', 0.5), ('is the', 0.0))"


def _phrase_steps() -> str:
    """The steps with emphatic `never` and `without doubt`, then idioms, dampening phrases and `least`."""
    steps = STEPS_SQL
    for n, behind in ((2, ["b1"]), (3, ["b1", "b2"])):
        boosted = "(v + case when v < 0 then -step else step end)"
        mark = f"when lower(b{n}) in ({sql_list(sentiment.NEGATIONS)})"
        never = " or ".join(f"lower({b}) in ('so', 'this')" for b in behind)
        doubt = " or ".join(f"lower({b}) = 'doubt'" for b in behind)
        steps = steps.replace(mark, f"when lower(b{n}) = 'never' and ({never}) then {boosted} * cast(1.25 as double) "
                                    f"when lower(b{n}) = 'without' and ({doubt}) then {boosted} {mark}")
    places = ["b2 || ' ' || b1 || ' ' || word", "word || ' ' || a1 || ' ' || a2", "b3 || ' ' || b2 || ' ' || b1",
              "b1 || ' ' || word", "word || ' ' || a1", "b2 || ' ' || b1", "b3 || ' ' || b2"]
    found = ", ".join(f"(select i.valence from idioms i where i.phrase = lower({p}))" for p in places)
    damped = " + ".join(f"case when lower({p}) in ('kind of', 'and the', 'in the') then 1 else 0 end"
                        for p in ("b3 || ' ' || b2 || ' ' || b1", "b3 || ' ' || b2", "b2 || ' ' || b1"))
    return steps + f"""
idioms as (select column0 as phrase, cast(column1 as double) as valence from (select * from {PHRASE_VALUES_SQL} t(column0, column1))),
v4 as (
  select * exclude (v), (case when v is not null then coalesce({found}, v) end - ({damped}) * cast(0.293 as double))
         * case when lower(b1) = 'least' and coalesce(lower(b2) not in ('at', 'very'), true) then cast(-0.74 as double) else 1 end as v
  from v3),"""


def _label_lexicon(q):
    """A lexicon learnt from the labels, stored because the job reads it several times."""
    judged = q("comments_doc").filter("is_spam is not null").withColumn("good", ~F.col("is_spam"))
    return checkpointed(sentiment.label_lexicon(judged, "good"))


SCORES_SQL = """
select c.comment_id, coalesce(round(down / nullif(up + down + flat, 0), 3), 0) as neg,
       coalesce(round(flat / nullif(up + down + flat, 0), 3), 0) as neu,
       coalesce(round(up / nullif(up + down + flat, 0), 3), 0) as pos,
       coalesce(round(total / sqrt(total * total + 15), 4), 0) as compound
from comments_doc c left join stressed s on c.comment_id = s.comment_id"""


@query(["comments_doc"], f"with {SENTIMENT_SQL.replace('{steps}', STEPS_SQL)}{SCORES_SQL}")
def lexicon_sentiment(q):
    return sentiment.lexicon_sentiment(q("comments_doc"), _label_lexicon(q))


@query(["comments_doc"], f"with {SENTIMENT_SQL.replace('{steps}', _phrase_steps()).replace('end, 0) as v from v3)', 'end, 0) as v from v4)')}{SCORES_SQL}")
def phrase_sentiment(q):
    """Sentiment with phrases: idioms, two-word dampeners, emphatic negations and `least`."""
    return sentiment.lexicon_sentiment(q("comments_doc"), _label_lexicon(q), phrases=SOME_PHRASES)


# ---- moderation by a text model


def _queue_batches(q):
    queue = unclassified(q("comments_doc")).select("video_id", "comment_id", "timestamp", "text")
    return ordering.moderation_batches(queue)


@query(["comments_doc"], f"""
with numbered as (
  select video_id, text, row_number() over (partition by video_id order by timestamp, comment_id) as r
  from comments_doc where classification is null)
select video_id, cast(ceil(r / 10.0) as bigint) as batch_no, count(*) as batch_rows,
       string_agg('Comment ' || ((r - 1) % 10 + 1) || ': ' || text, chr(10) order by r) || chr(10)
       || '{moderation.INSTRUCTIONS}' as prompt
from numbered group by video_id, cast(ceil(r / 10.0) as bigint)""")
def moderation_prompts(q):
    return moderation.moderation_prompts(_queue_batches(q))


def _replies(q):
    """Replies as a model would give them for batches of the judged comments, with the reason left out now and then."""
    judged = q("comments_ev").filter("classification is not null")
    batches = ordering.moderation_batches(judged)
    block = F.concat(
        F.lit("Comment "), F.col("comment_no").cast("string"), F.lit(":\n- Classification: "), F.initcap("content_class"),
        F.lit("\n- Action: "), F.upper("mod_action"), F.lit("\n- Reason: by: "), F.col("author"),
    )
    lines = F.array_sort(F.collect_list(F.struct("comment_no", block.alias("block"))))
    replies = batches.groupBy("video_id", "batch_no").agg(
        F.count("*").alias("batch_rows"),
        F.concat(F.lit("Here is my answer.\n"), F.array_join(F.transform(lines, lambda x: x["block"]), "\n")).alias("reply"),
    )
    return batches, replies


JUDGED_BATCHES = """
judged as (
  select *, row_number() over (partition by video_id order by timestamp, comment_id) as r
  from comments_ev where classification is not null)"""


@query(["comments_ev"], f"""
with {JUDGED_BATCHES}
select video_id, cast(ceil(r / 10.0) as bigint) as batch_no, (r - 1) % 10 + 1 as comment_no,
       content_class as classification, mod_action, 'by: ' || author as reason
from judged where mod_action is not null""")
def parse_moderation(q):
    _, replies = _replies(q)
    return moderation.parse_moderation(replies)


@query(["comments_ev"], """
select comment_id, case when mod_action is null then classification else content_class end as classification, mod_action,
       case when mod_action is not null and classification is not null then 'by: ' || author end as reason
from comments_ev""")
def apply_moderation(q):
    batches, replies = _replies(q)
    moderated = moderation.apply_moderation(q("comments_ev"), batches, moderation.parse_moderation(replies))
    return moderated.select("comment_id", "classification", "mod_action", "reason")


@query()
def summary_prompts(q):
    return video_stats.summary_prompts(video_stats.comment_stats_document(q("comments_doc")))


INSULTS = ["idiot", "moron", "stupid", "scum", "trash", "loser"]


def rule_reply_maker():
    """Replies by rule: insults are removed, license lines flagged. A prompt about none of its comments is refused."""
    import re

    def decide(text):
        low = text.lower()
        found = [w for w in INSULTS if w in low]
        if found:
            return "offensive", "remove", f"insult: {found[0]}"
        return ("spam", "flag", "license line") if "license" in low else ("neutral", "allow", "no rule matched")

    def reply(prompts):
        def answer(prompt):
            head = prompt[:prompt.rindex("\n\nClassify every comment")]
            texts = re.split(r"(?m)^Comment \d+: ", head)[1:]
            if not any(ch.isalpha() for t in texts for ch in t):
                raise ValueError("nothing to judge")
            blocks = ["Comment {}:\n- Classification: {}\n- Action: {}\n- Reason: {}".format(n, *decide(t))
                      for n, t in enumerate(texts, 1)]
            return "\n".join(blocks)
        return prompts.map(answer)

    return reply


FIRST_INSULT = "case " + " ".join(f"when contains(lower(text), '{w}') then '{w}'" for w in INSULTS) + " end"


ROUND_SQL = f"""
with numbered as (
  select video_id, text, row_number() over (partition by video_id order by timestamp, comment_id) as r
  from comments_doc where classification is null),
judged as (select *, {FIRST_INSULT} as insult, contains(lower(text), 'license') as licensed from numbered)
select video_id, cast(ceil(r / 10.0) as bigint) as batch_no, (r - 1) % 10 + 1 as comment_no,
       case when insult is not null then 'offensive' when licensed then 'spam' else 'neutral' end as classification,
       case when insult is not null then 'remove' when licensed then 'flag' else 'allow' end as mod_action,
       case when insult is not null then 'insult: ' || insult when licensed then 'license line' else 'no rule matched' end as reason
from judged"""


@query(["comments_doc"], ROUND_SQL)
def call_scorer(q):
    """The whole round: prompts, replies by rule, parsed decisions."""
    prompts = moderation.moderation_prompts(_queue_batches(q))
    return moderation.parse_moderation(moderation.call_scorer(prompts, rule_reply_maker).drop("error"))


def never_reply_maker():
    raise AssertionError("every reply is in the ledger")


@query(["comments_doc"], ROUND_SQL)
def recorded_replies(q):
    """The whole round a second time: every reply comes out of the ledger, and the model is not even made."""
    prompts, folder = moderation.moderation_prompts(_queue_batches(q)), scratch_dir(q.spark, "ledger")
    ledger.call_recorded(prompts, rule_reply_maker, folder).write.format("noop").mode("overwrite").save()
    replies = ledger.call_recorded(prompts, never_reply_maker, folder)
    return moderation.parse_moderation(replies.drop("error"))


@query(["comments_doc", "model_scores"], """
select comment_id as key, cast(3 as bigint) as attempts, 'no scores' as last_error
from comments_doc where (classification is null or spam_score is null) and cast(comment_id as bigint) % 10 = 0""")
def dead_letters(q):
    """Comments that no run could analyse, after three runs in which ever more scores came: a tenth has none at all."""
    comments, path, number = q("comments_doc"), scratch_dir(q.spark, "failures"), F.col("comment_id").cast("long")
    scores = _toxicity(q).select("comment_id", "p", "toxicity", "compound")
    for run in range(3):
        come = scores.filter((number % 10 != 0) & (number % 10 <= 3 * run + 3))
        queue = ledger.still_waiting(comments, ledger.failures(q.spark, path), "comment_id")
        results = analyze.analyze_queue(queue.join(come, "comment_id", "left"))
        ledger.record_failures(results.filter("is_error").withColumn("error", F.lit("no scores")), path, "comment_id", "error", run)
    return ledger.dead_letters(ledger.failures(q.spark, path))
