"""Top-k search, token files, tool calls, order hashes: beside brute force."""

import hashlib
import json
import math
import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadwise.llm import chat, orderhash, tokens, topk

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def slow_top_k(rows, k, asks):
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in whole:
        if asks(q):
            scores = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items()
                      if i != q and len(v) == len(whole[q])]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("segments", [1, 2, 5])
def test_top_k_is_exact(spark, monkeypatch, segments):
    monkeypatch.setattr(topk, "VECTORS", 60)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 12).astype(np.float32).tolist()) for i in range(200)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # many copies
    rows += [(300, None), (310, [1.0, None] * 6), (320, [float("nan")] * 12), (330, [float("inf")] * 12),
             (None, rows[0][1]), (340, [-0.0] * 12), (350, [1.0] * 3), (360, [2.0] * 3), rows[5], rows[5], (370, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = topk.top_k(df, F.col("id") % 10 == 0, 10, segments=segments)
    want = slow_top_k(rows, 10, lambda i: i % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_top_k_of_huge_components_and_of_nothing(spark):
    rows = [(0, [3e12, -1e12]), (1, [2e12, 1e12]), (2, [2e12, 1e12 + 1]), (3, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in topk.top_k(df, F.col("id") == 3, 2).collect()}
    assert got == {(3, 1): 2, (3, 2): 1} or got == {(3, 1): 1, (3, 2): 2}
    big = {r["vec_id"]: r["score"] for r in topk.top_k(df, F.col("id") == 0, 3).collect()}
    assert big[1] == big[2] == (1 << 63) - 1
    assert topk.top_k(df.where("vec_id < 0"), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("layout", ["byte", "bit"])
def test_planes_round_trip(layout):
    rng = np.random.default_rng(2)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (tokens.ids_of(tokens.planes_of(ids, layout), n, layout) == ids).all()


def test_joined_checksums():
    data = random.Random(3).randbytes(5000)
    parts = [data[:1], data[1:1000], b"", data[1000:]]
    assert tokens.joined_crc([(len(p), crc32(p)) for p in parts]) == crc32(data)


TEXTS = [
    "The quick brown fox, isn't it?", "Don't STOP. N0w 123 é É ÀÉ ñandú straße", "a\tb\nc\r\nd  e ", "", None, "   ",
    "x<|endoftext|>y <|startoftext|>", "İstanbul Σίσυφος ΟΔΟΣ. éte ́x", "日本語 テスト，混ぜる 😀 a b c d \x1cz",
    "word. word, Word Word. wOrd", "long " * 3000, "ﬁ Ⅷ ½ ª º µ",
]


def test_remembered_chunks_give_the_ids_of_whole_texts():
    whole, encoder = Tokenizer.from_file(TOKENIZER), tokens.Encoder(TOKENIZER)
    for text in TEXTS + TEXTS:
        want = whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("layout,block", [("byte", 1 << 16), ("bit", 64), ("byte", 5)])
def test_token_files_round_trip(spark, tmp_path, layout, block):
    ids = [30, 20, None, 5, 5, 7, 8, 9, 10, 11, 12, 5]
    rows = list(zip(ids, TEXTS)) + [(5, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    tokens.write_token_files(df, f"file://{tmp_path}/t", TOKENIZER, block, layout)
    got = sorted(tokens.read_documents(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    whole, start, left = Tokenizer.from_file(TOKENIZER), 0, [(i, t) for i, t in rows]
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        match = next(x for x in left if x[0] == r["doc_id"] and r["ids_crc32"] == crc32(np.array(
            whole.encode(x[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))
        left.remove(match)
    assert not left
    empty = df.limit(0)
    tokens.write_token_files(empty, f"file://{tmp_path}/e", TOKENIZER)
    assert tokens.read_documents(spark, f"file://{tmp_path}/e").count() == 0


SCHEMAS = {"add": {"required": ["a", "b"], "properties": {
    "a": {"type": "integer", "minimum": 0}, "b": {"type": "number", "maximum": 10}, "note": {"type": "string", "maxLength": 3}}}}
MESSAGES = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string"


def test_tool_calls_are_linked_ordered_and_checked(spark):
    rows = [
        (1, 0, "user", "hi", None, None, None),
        (1, 1, "tool", "3", "x", None, None),  # before its call
        (1, 2, "assistant", None, "x", "add", '{"b": 2.50, "a": 1}'),
        (1, 3, "assistant", None, "x", "add", '{"a": -1, "b": 11, "c": 0, "note": "long"}'),
        (1, 4, "assistant", None, "y", "add", '{"a": "1"}'),
        (1, 5, "tool", "?", "z", None, None),
        (1, 6, "assistant", None, "w", "sub", "no json"),
        (1, 7, "assistant", None, "v", "add", "[1]"),
        (2, 0, "tool", "other conversation", "y", None, None),
        (None, 0, "tool", None, "x", None, None), (1, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], MESSAGES + ", call_turn long")
    got = {(r["conv_id"], r["turn"]): r for r in chat.linked_messages(df, SCHEMAS).collect()}
    assert len(got) == len(rows)
    links = {k: r["link"] for k, r in got.items()}
    assert links == {(1, 0): "plain", (1, 1): "linked", (1, 2): "answered", (1, 3): "repeated", (1, 4): "unanswered",
                     (1, 5): "orphan", (1, 6): "unanswered", (1, 7): "unanswered", (2, 0): "orphan",
                     (None, 0): "orphan", (1, None): "plain"}
    order = sorted((r for k, r in got.items() if k[0] == 1 and k[1] is not None), key=lambda r: (r["at"], r["step"], r["turn"]))
    assert [r["turn"] for r in order] == [0, 2, 1, 3, 4, 5, 6, 7]
    errors = {k: r["errors"] for k, r in got.items()}
    assert errors[1, 2] == [] and errors[1, 1] is None
    assert errors[1, 3] == ["minimum of a", "maximum of b", "maxLength of note", "unknown argument"]
    assert errors[1, 4] == ["missing b", "type of a"]
    assert errors[1, 6] == ["unknown tool"] and errors[1, 7] == ["no JSON object"]
    assert got[1, 2]["json"] == '{"arguments":"{\\"a\\":1,\\"b\\":2.5}","call_id":"x","name":"add","role":"assistant"}'
    assert json.loads(got[1, 6]["json"])["arguments"] == "no json"
    assert chat.linked_messages(df.limit(0), SCHEMAS).count() == 0


def test_canonical_json_sorts_keys_at_every_depth(spark):
    df = spark.createDataFrame([('{"b": [1, {"z": null, "y": "é\\n"}], "a": {"d": true, "c": 1.0}}',), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(chat.canonical_json(F.col("t"))).collect()]
    assert got == ['{"a":{"c":1,"d":true},"b":[1,{"y":"é\\n","z":null}]}', None, None]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_order_hashes_of_edited_texts(spark):
    rng = random.Random(4)
    base = words(rng, 300).split()
    swapped = base[150:] + base[:150]
    rng.shuffle(shuffled := list(base))
    texts = [" ".join(base), " ".join(base), " ".join(base[:290] + ["new"] * 10), " ".join(shuffled), " ".join(swapped),
             None, "", "é", "one", words(rng, 4000), "z" * 3000, words(rng, 40)]
    ids = [2, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, None]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("mine", F.lit(1))
    got = {r["doc_id"]: r for r in orderhash.edited_fingerprints(df).collect()}
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if edited == t:
            assert got[i]["near_edited"] == 1
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1
    assert got[2]["near_next"] > 0.7  # a few words changed
    assert got[3]["near_next"] < 0.1  # all words shuffled
    assert got[6]["near_next"] == 1 and got[6]["fingerprint"] == ""
    assert got[4]["near_edited"] > 0.02 and got[11]["near_edited"] > 0
    assert len({r["fingerprint"] for r in got.values()}) == len(ids) - 2


def slow_order_hash(codes, h2, k, tuples, length):
    """Tuples as lists of (k-mer, occurrence) in text order, from explicit hash functions."""
    seen, numbered = {}, []
    for i in range(len(codes) - k + 1):
        kmer = tuple(codes[i:i + k])
        seen[kmer] = seen.get(kmer, -1) + 1
        numbered.append((kmer, seen[kmer], i))
    groups = {}
    for kmer, occurrence, i in numbered:
        tuple_, rank = h2(kmer, occurrence)
        groups.setdefault(tuple_, []).append((rank, i, kmer, occurrence))
    return {g: [x[2:] for x in sorted(sorted(v)[:length], key=lambda x: x[1])] for g, v in groups.items()}


def test_order_hash_equals_brute_force_over_repeats(spark):
    """Same selected k-mers in the same order exactly where the signatures agree."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(3, 60))) for _ in range(30)]
    texts += [t + " a" for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    piece = {p: h for p, h in df.sparkSession.createDataFrame([(c,) for c in "abc"], "p string").select(
        "p", F.xxhash64("p")).collect()}
    kmers = [(a, b, c) for a in "abc" for b in "abc" for c in "abc"]
    hashed = spark.createDataFrame([(*[piece[x] for x in m], "".join(m)) for m in kmers], "a long, b long, c long, m string")
    bits = orderhash.POSITION + 1
    first = hashed.select("m", F.shiftrightunsigned(F.xxhash64("a", "b", "c"), bits).alias("h"))
    second = {(r["m"], r["o"]): r["x"] for r in first.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(70)))).select(
        "m", "o", F.shiftrightunsigned(F.xxhash64("h", "o"), bits).alias("x")).collect()}
    rank = lambda m, o: (second["".join(m), o] >> 30, second["".join(m), o])
    want = [slow_order_hash(t.split(), rank, 3, 64, 2) for t in texts]
    got = [{x >> 32: x & 0xFFFFFFFF for x in r[0]} for r in df.select(orderhash.fingerprint(F.col("t"))).collect()]
    known = {}
    for w, g in zip(want, got):
        assert set(w) == set(g)
        for tuple_, chosen in w.items():
            assert known.setdefault((tuple_, tuple(chosen)), g[tuple_]) == g[tuple_]
    assert len({v for v in known.values()}) == len({c for _, c in known})


DEEP = {"required": ["where"], "properties": {
    "where": {"type": "object", "required": ["city"], "properties": {
        "city": {"type": "string", "pattern": "^[A-Z]"}, "zone": {"enum": ["a", 2, None]}}},
    "tags": {"type": "array", "items": {"type": "string", "minLength": 2}},
    "free": {"type": "object", "additionalProperties": True}}}


@pytest.mark.parametrize("arguments,wrong", [
    ('{"where": {"city": "Rome"}}', []),
    ('{"where": {"city": "rome", "zone": "b", "more": 1}}', ["pattern of where.city", "enum of where.zone", "unknown argument of where"]),
    ('{"where": {"zone": 2}}', ["missing where.city"]),
    ('{"where": {"city": 7}}', ["type of where.city"]),
    ('{"where": [1]}', ["type of where"]),
    ('{"where": {"city": "A"}, "tags": ["ab", "cd"], "free": {"x": [1]}}', []),
    ('{"where": {"city": "A"}, "tags": ["ab", "c"]}', ["items of tags"]),
    ('{"where": {"city": "A"}, "tags": ["ab", 3], "free": 1}', ["items of tags", "type of free"]),
    ('{}', ["missing where"]), (None, ["no JSON object"]), ("3", ["no JSON object"]),
])
def test_nested_schemas(spark, arguments, wrong):
    df = spark.createDataFrame([(arguments,)], "a string")
    assert df.select(chat.argument_errors(F.col("a"), DEEP)).first()[0] == wrong


def test_unknown_keywords_of_a_schema_are_refused(spark):
    for schema in ({"properties": {"a": {"format": "date"}}}, {"oneOf": []}, {"properties": {"a": {"items": {"const": 1}}}}):
        with pytest.raises(ValueError, match="unknown"):
            chat.argument_errors(F.col("a"), schema)


def test_results_meet_their_calls_in_a_hash_join(spark):
    df = spark.createDataFrame([(1, 0, "tool", "x", "k", None, None)], MESSAGES)
    plan = chat.linked_messages(df, {})._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_marks_behind_a_word_need_no_whole_encoding(monkeypatch):
    """Runs of marks behind words get the library's ids by the word model; apostrophes and other letters do not."""
    whole, encoder = Tokenizer.from_file(TOKENIZER), tokens.Encoder(TOKENIZER)
    chunks = ["en\xe9&&&", "Tree$$$", "a.", "end...\")", "x->", "it's!", "don't", "%%%", "\u4e2d\u6587,,", "12%%", "e\u0301**", "a_b__"]
    for chunk in chunks + [w + a + b for w in ("ab", "\xc9t\xe9") for a in tokens.MARKS for b in tokens.MARKS]:
        want = np.array(whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(chunk) == want, chunk
    monkeypatch.setattr(encoder, "_whole", lambda text: 1 / 0)
    assert encoder.encode("other&&& words$$$ here...") == np.array(whole.encode("other&&& words$$$ here...", add_special_tokens=False).ids, "<u4").tobytes()


def test_remembered_chunks_are_dropped_beyond_the_limit(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    whole, encoder = Tokenizer.from_file(TOKENIZER), tokens.Encoder(TOKENIZER)
    for text in ("one two three four", "five six", None, "one two"):
        assert encoder.encode(text) == np.array(whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
    assert len(encoder.known) < 6


def whole_ids(whole, text):
    return np.array(whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_long_chunks_and_many_words_are_not_held(monkeypatch):
    """What is remembered is bounded by characters as well as by words: texts without blanks are one chunk each."""
    monkeypatch.setattr(tokens, "REMEMBERED_CHARS", 20_000)
    whole, encoder, held = Tokenizer.from_file(TOKENIZER), tokens.Encoder(TOKENIZER), 0
    for n in range(30):
        text = "日本語テスト" * 400 + str(n)
        assert encoder.encode(text) == whole_ids(whole, text)
        held = max(held, sum(map(len, encoder.known)))
    assert held < 25_000


def test_groups_and_parts_of_texts_give_the_ids_of_whole_texts(monkeypatch):
    whole, rng = Tokenizer.from_file(TOKENIZER), random.Random(7)
    letters = [*"abcdeXYZ éÀßñµªΣςİ日本😀059'’\"!,.-_<>| \t\n\r\x0b\x0c\x1c\x85\xa0​́ ", "<|endoftext|>", "don't", " the "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)] + TEXTS
    want = [whole_ids(whole, t) for t in texts]
    for part, remembered, words in ((20, 3, 2), (300, 60, 5000), (1 << 22, 300_000, 5000)):
        for name, value in (("PART", part), ("REMEMBERED", remembered), ("WORDS", words)):
            monkeypatch.setattr(tokens, name, value)
        encoder = tokens.Encoder(TOKENIZER)
        assert list(encoder.encode_all(texts)) == list(encoder.encode_all(texts)) == want
    assert "".join(tokens.parts_of("a b c" * 9)) == "a b c" * 9


def test_words_met_again_are_kept_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    whole, encoder = Tokenizer.from_file(TOKENIZER), tokens.Encoder(TOKENIZER)
    for text in ("often one two three", "often four five six", "often seven eight", "nine often one."):
        assert encoder.encode(text) == whole_ids(whole, text)
    assert "often" in encoder.known and "two" not in encoder.known


def test_an_encoder_goes_on_after_a_failure(monkeypatch):
    """A worker keeps its encoder; words that a failed task left without ids must not shift those of later ones."""
    whole, encoder = Tokenizer.from_file(TOKENIZER), tokens.Encoder(TOKENIZER)
    with monkeypatch.context() as patch:
        patch.setattr(encoder, "_whole", lambda text: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            encoder.encode("new words and 12")
    for text in ("other words and 34", "new 12 and words"):
        assert encoder.encode(text) == whole_ids(whole, text)


def test_scans_of_texts_hold_few_rows(spark):
    held = spark.conf.get(tokens.READER_ROWS)
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    try:
        for before, after in (("4096", str(tokens.SCANNED)), ("100", "100")):
            spark.conf.set(tokens.READER_ROWS, before)
            tokens.encoded_blocks(df, TOKENIZER)
            assert spark.conf.get(tokens.READER_ROWS) == after
    finally:
        spark.conf.set(tokens.READER_ROWS, held)
