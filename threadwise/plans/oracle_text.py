"""SQL pieces of the oracles that several queries share."""

from threadwise import constants as C


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_of(target: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains({target}, '{p}')" for p in phrases) + ")"


STOP_SQL = sql_list(C.STOP_WORDS)
SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UPPER = r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]"
DIGIT = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}]"
MARK = r"[!-/:-@\[-`{-~]"

WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
LONG_WORDS_SQL = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) > 2)"
SPLIT_SQL = f"regexp_extract_all(lower(text), '{SPACE.replace('[', '[^', 1)}+')"


def count_chars(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


def per_char(count: str) -> str:
    return f"{count} / cast(greatest(length(text), 1) as double)"


def count_mark(mark: str) -> str:
    return f"(length(text) - length(replace(text, '{mark}', '')))"


RATIO_SQL = {
    "exact_hits": f"len(list_filter({SPLIT_SQL}, lambda w: w in ({sql_list(C.SPAM_WORDS)})))",
    "lexicon_hits": f"len(list_filter([{sql_list(C.SPAM_WORDS)}], lambda e: contains(lower(text), e)))",
}
RATIO_SQL["spam_word_ratio"] = (
    f"round(least(({RATIO_SQL['exact_hits']} + {RATIO_SQL['lexicon_hits']}) / cast(len({SPLIT_SQL}) + 1 as double), 1.0), 6)"
)

FEATURES_SQL = {
    "length": "length(text)",
    "word_count": f"len({SPLIT_SQL})",
    "avg_word_length": f"round(length(array_to_string({SPLIT_SQL}, '')) / cast(greatest(len({SPLIT_SQL}), 1) as double), 6)",
    "capitals_ratio": f"round({per_char(count_chars(UPPER))}, 6)",
    "digits_ratio": f"round({per_char(count_chars(DIGIT))}, 6)",
    "punctuation_ratio": f"round({per_char(count_chars(MARK))}, 6)",
    "exclamation_count": count_mark("!"),
    "question_count": count_mark("?"),
    "url_count": f"len(list_filter({SPLIT_SQL}, lambda w: contains(w, 'http') or contains(w, 'www.')))",
    "has_email": r"cast(regexp_matches(text, '[^@]@[^@]+\.[^@]') as bigint)",
    "spam_word_ratio": RATIO_SQL["spam_word_ratio"],
}


def flag(condition: str) -> str:
    return f"cast({condition} as bigint)"


INDICATORS_SQL = {
    "has_url": flag(any_of("lower(text)", ["http", "www."])),
    "has_price": flag(any_of("text", ["$", "€"]) + " or contains(lower(text), 'price')"),
    "has_crypto": flag(any_of("lower(text)", ["crypto", "bitcoin", "eth"])),
    "has_promotion": flag(any_of("lower(text)", ["discount", "offer", "free"])),
    "has_contact": flag(any_of("lower(text)", ["contact", "email", "call"])),
    "excessive_punctuation": flag(f"{count_mark('!')} > 3 or {count_mark('?')} > 3"),
    "all_caps_ratio": per_char(count_chars(UPPER)),
}
WHITELIST_SQL = f"({any_of('lower(text)', C.WHITELIST_PHRASES)} and length(text) < 100)"

# Spam verdict over the columns text and p.
VERDICT_SQL = {
    "is_spam": f"""case when {WHITELIST_SQL} or p is null or length(text) < 20 or len({SPLIT_SQL}) < 5 then false
      else p > cast(0.85 as double) or ({' + '.join(INDICATORS_SQL.values())} >= 4 and p > cast(0.75 as double)) end""",
    "confidence": f"case when {WHITELIST_SQL} then cast(0.9 as double) when p is null then cast(0.5 as double) else greatest(p, 1 - p) end",
    "spam_score": f"case when {WHITELIST_SQL} then cast(0.1 as double) when p is null then cast(0.5 as double) else p end",
}

_STATS = """
  select {key}count(*) as total_comments, count(case when responded then 1 end) as responded_comments,
         round(count(case when responded then 1 end) * 100 / cast(count(*) as double), 2) as response_rate,
         count(distinct author) as unique_authors, round(avg(emotional_score), 2) + 0.0 as avg_emotional_score,
         round(max(emotional_score), 2) as max_emotional_score, round(min(emotional_score), 2) as min_emotional_score,
         count(case when emotional_score > cast(0.5 as double) then 1 end) as positive,
         count(case when emotional_score >= cast(0.3 as double) and emotional_score <= cast(0.7 as double) then 1 end) as neutral,
         count(case when emotional_score < cast(0.5 as double) then 1 end) as negative,
         min(timestamp) as first_comment, max(timestamp) as last_comment,
         round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / cast(3600000000 as double) / (count(*) - 1), 2)
           as avg_hours_between
  from comments_doc {group}"""

# CTEs `stats` (per video) and `stats_all` (one row) over comments_doc.
STATS_SQL = f"""
doc_words as (
  select video_id, cast(sum(len(list_filter({LONG_WORDS_SQL}, lambda w: w not in ({STOP_SQL})))) as bigint) as total_word_count
  from comments_doc group by video_id),
doc_hours as (select video_id, hour(timestamp) as h, count(*) as n, min(timestamp) as seen from comments_doc group by all),
doc_best as (
  select video_id, h as most_active_hour from doc_hours
  qualify row_number() over (partition by video_id order by n desc, seen) = 1),
all_best as (
  select h as most_active_hour from (select h, sum(n) as n, min(seen) as seen from doc_hours group by h)
  order by n desc, seen limit 1),
doc_base as ({_STATS.format(key='video_id, ', group='group by video_id')}),
all_base as ({_STATS.format(key='', group='')}),
stats as (
  select b.*, most_active_hour, total_word_count, round(total_word_count / cast(total_comments as double), 2) as avg_words_per_comment
  from doc_base b join doc_best using (video_id) join doc_words using (video_id)),
stats_all as (
  select b.*, most_active_hour, total_word_count, round(total_word_count / cast(total_comments as double), 2) as avg_words_per_comment
  from all_base b, all_best, (select cast(sum(total_word_count) as bigint) as total_word_count from doc_words))"""
