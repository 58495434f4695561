"""One query for each operator, over its whole table, and the pipeline."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

import corpus_pipeline
from threadwise.llm import (
    chat, lm, mixing, orderhash, packing, repetition, simhash, substring, tokens, topk, toxicity,
    vectorcodes, whitening,
)
from threadwise.llm.shared import table, text_key, word_count
from threadwise.session import scratch_dir


def op1_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.scored(docs, lm.train(docs))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of 2048 words; copies of a text are a cluster."""
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs.select(
        "doc_id", "source", text_key(F.col("text")).alias("cluster"), word_count(F.col("text")).alias("length")))


def op3_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from the token files."""
    path = scratch_dir(spark, "tokens")
    tokens.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_documents(spark, path)


def op4_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of each vector whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


#: The table has no tool messages; each user turn is taken as a call of this tool, the reply after it as its result.
REPLY = {"reply": {
    "required": ["prompt", "words"],
    "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400},
                   "words": {"type": "integer", "minimum": 5, "maximum": 64}},
}}


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as calls and results: a user turn calls, the assistant's turn after it is the result."""
    turns = table(spark, sf_dir, "conversations")
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    number = F.when(user, F.col("turn")).when(reply, F.col("turn") - 1)
    messages = turns.select(
        "conv_id", "turn", F.when(reply, "tool").otherwise(F.col("role")).alias("role"),
        F.when(~user, F.col("text")).alias("text"), F.concat(F.lit("call-"), number.cast("string")).alias("call_id"),
        F.when(user, "reply").alias("tool"),
        F.when(user, F.to_json(F.struct(word_count(F.col("text")).alias("words"), F.col("text").alias("prompt")))).alias(
            "arguments"))
    return chat.linked_messages(messages, REPLY).withColumn("errors", F.array_join("errors", "; "))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier one, with the documents where they stay."""
    return substring.repeated_passages(table(spark, sf_dir, "documents")).drop("thash")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("thash")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select("doc_id", "text"), machine).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measured(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.coded(table(spark, sf_dir, "embeddings")).drop("label")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_masked_likelihood, op2_best_fit_packing, op3_plane_tokens, op4_uniform_threshold, op5_tool_call_linking,
        op6_paragraph_dedup, op7_source_mixing, op8_simhash_dedup, op9_order_minhash, op10_toxicity_machine,
        op11_repetition_coverage, op12_vector_codes, op13_embedding_whitening,
    )
} | {"pipeline": corpus_pipeline.run}

#: Percent limits of the repetition rules by n-gram length, as in repetition.Rules.
_GRAMS = repetition.Rules().ngrams


def _vector_codes_sql(parts: int = vectorcodes.PARTS, entries: int = vectorcodes.ENTRIES, rounds: int = vectorcodes.ROUNDS) -> str:
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
a{n} as materialized (
  select r, part, y, k, d from (
    select p.r, p.part, p.y, b.k,
           list_sum(list_transform(list_zip(p.y, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d,
           row_number() over (partition by p.r, p.part order by d, b.k) as n
    from p join b{n} b on p.part = b.part) where n = 1)""")
        if n < rounds:
            steps.append(f"""
s{n} as materialized (
  select part, k, list((s - ((s % n) + n) % n) // n order by i) as c from (
    select part, k, i, sum(x)::bigint as s, count(*) as n from (
      select part, k, unnest(y) as x, unnest(range(len(y))) as i from a{n}) group by part, k, i) group by part, k),
b{n + 1} as materialized (select b.part, b.k, coalesce(s.c, b.c) as c from b{n} b left join s{n} s on b.part = s.part and b.k = s.k)""")
    return f"""
with v as materialized (
  select row_number() over () as r, vec_id, label,
         list_transform(embedding, lambda x: cast(floor({vectorcodes.SCALE} * cast(x as double)) as bigint)) as x
  from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (
  select r, part, list_slice(x, part * len(x) // {parts} + 1, (part + 1) * len(x) // {parts}) as y
  from v, (select unnest(range({parts})) as part)),
b0 as materialized (
  select part, k, y as c from p join (select r, row_number() over (order by vec_id) - 1 as k from v) using (r) where k < {entries}),
{",".join(steps)},
digest as (
  select sha256(string_agg(t, ',' order by part, k)) as codebooks_sha256 from (
    select part, k, list_aggregate(c, 'string_agg', ',') as t from b{rounds})),
coded as (
  select vec_id, label, code, error from v join (
    select r, string_agg(printf('%02x', k::bigint), '' order by part) as code, sum(d)::bigint as error from a{rounds} group by r) using (r))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded, digest"""


ORACLES: dict[str, str] = {
    "op12_vector_codes": _vector_codes_sql(),
    "op11_repetition_coverage": r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (
  select r, unnest(words) as word, unnest(range(len(words))) as i, len(words) as n
  from (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d)),
counts as (select r, count(*) as n_words, sum(length(word)) as word_chars from w group by r),
lines as (
  select r, line, i from (select r, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
told as (select *, row_number() over (partition by r, line order by i) > 1 as again from lines),
line_counts as (
  select r, count(*) filter (again) as n_dup_lines, sum(length(line)) as line_chars,
         coalesce(sum(length(line)) filter (again), 0) as dup_line_chars from told group by r),
""" + ",\n".join(f"""
g{k} as (select r, i, {" || ' ' || ".join(["word", *[f"lead(word, {j}) over v" for j in range(1, k)]])} as g from w window v as (partition by r order by i)),
s{k} as (select r, i, row_number() over (partition by r, g order by i) as copy, count(*) over (partition by r, g) as copies from g{k} where g is not null),
m{k} as (select distinct r, i + j as i from s{k}, (select unnest(range({k})) as j) where {"copies" if k == 3 else "copy"} > 1),
c{k} as (select r, {"count(*)" if k == 3 else "sum(length(word))"} as n from m{k} join w using (r, i) group by r)""" for k in (3, *_GRAMS)) + """,
measures as (
  select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
         coalesce(c3.n, 0) as n_repeat_words, coalesce(line_chars, 0) as line_chars, coalesce(dup_line_chars, 0) as dup_line_chars,
         """ + ", ".join(f"coalesce(c{k}.n, 0) as covered_{k}" for k in _GRAMS) + """
  from d left join counts using (r) left join line_counts using (r) """ + " ".join(
        f"left join c{k} using (r)" for k in (3, *_GRAMS)) + """),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measures)
select doc_id, """ + ", ".join(f"cast({c} as bigint) as {c}" for c in repetition.Measurer(repetition.Rules()).names()) + """,
       base_failed, not base_failed and 100 * dup_line_chars <= 20 * line_chars
       and """ + " and ".join(f"100 * covered_{k} <= {most} * word_chars" for k, most in _GRAMS.items()) + """ as kept
from judged""",
    "op4_uniform_threshold": """
with v as (select vec_id, [cast(floor(1024 * cast(x as double)) as double) for x in embedding] as e from embeddings),
pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10""",
    "op5_tool_call_linking": r"""
with t as (
  select *, case role when 'user' then turn when 'assistant' then turn - 1 end as number,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from conversations),
l as (
  select t.*, 'call-' || number as call_id,
         exists (select 1 from t c where c.conv_id = t.conv_id and c.role = 'user' and c.turn = t.number) as has_call,
         exists (select 1 from t r where r.conv_id = t.conv_id and r.role = 'assistant' and r.number = t.number) as has_result
  from t)
select conv_id, turn, case role when 'assistant' then 'tool' else role end as role, call_id,
       case when role = 'user' and has_result then 'answered' when role = 'user' then 'unanswered'
            when role = 'assistant' and has_call then 'linked' when role = 'assistant' then 'orphan' else 'plain' end as link,
       turn as "at", 0 as step,
       case when role = 'user' then concat_ws('; ',
         case when length(text) < 1 then 'minLength of prompt' end, case when length(text) > 400 then 'maxLength of prompt' end,
         case when words < 5 then 'minimum of words' end, case when words > 64 then 'maximum of words' end) end as errors,
       cast(case when role = 'user' then to_json({'arguments': cast(to_json({'prompt': text, 'words': words}) as varchar),
                                                  'call_id': call_id, 'name': 'reply', 'role': role})
                 when role = 'assistant' then to_json({'call_id': call_id, 'content': text, 'role': 'tool'})
                 else to_json({'content': text, 'role': role}) end as varchar) as json
from l""",
}
