"""Token ids in bit-plane files: fixed-size blocks of ids, transposed, compressed plane by plane, with a chunk index."""

import re
import sys
from collections.abc import Iterable, Iterator
from types import ModuleType
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from threadwise.llm.shared import JOINED_ID, in_small_batches, split_id, text_key

END_ID = 1
#: Ids of a block.
BLOCK = 1 << 16
LEVEL = 1
#: Words and chunks whose ids a worker remembers, and their characters, at most, but for the last texts: about 50 MB.
REMEMBERED, REMEMBERED_CHARS = 300_000, 6_000_000
#: Characters of texts that are split and looked up together, at most, where a blank allows it.
PART = 1 << 22
BLANK = re.compile(r"[ \t\n\v\f\r]")
#: Rows of texts that a Parquet scan holds at once, at most: its buffers are as large as all their texts, and doubled.
SCANNED = 256
READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
#: Words that go to the library's word model in one call.
WORDS = 5000
#: Marks that stand together as one word behind a word; an apostrophe would join letters, so it is none of them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters of plain Latin words.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
POLYNOMIAL = 0xEDB88320

FILE_SCHEMA = (
    "shard int, chunk long, first long, n_ids int, layout string, planes array<binary>, "
    "doc_row array<long>, doc_id array<long>, doc_ids array<int>")


def planes_of(ids: np.ndarray, layout: str) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of 32-bit ids, lowest first."""
    values = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if layout == "byte":
        return [p.tobytes() for p in values.T]
    bits = np.unpackbits(values, axis=1, bitorder="little")
    return [np.packbits(p).tobytes() for p in bits.T]


def ids_of(planes: list[bytes], n: int, layout: str) -> np.ndarray:
    rows = [np.frombuffer(p, np.uint8) for p in planes]
    if layout == "bit":
        bits = np.stack([np.unpackbits(r, count=n) for r in rows], 1)
        return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack(rows, 1)).reshape(-1).view("<u4")


class Remembered(dict):
    """The number of each word or chunk; one that is not there gets the next number and waits in `new` for its ids."""

    def __init__(self, words: Iterable[str] = ("",)):
        super().__init__({w: n for n, w in enumerate(words)})
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


def gathered(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the chosen runs one behind the other, and where each ends; run i ends before ends[i]."""
    starts = np.concatenate([[0], ends[:-1]])[which]
    n = ends[which] - starts
    behind = n.cumsum()
    at = np.repeat(starts - behind + n, n)
    at += np.arange(len(at))
    return ids[at], behind


def parts_of(text: str) -> Iterator[str]:
    """The text cut at the first blank after each PART characters."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + PART)
        end = blank.end() if blank else len(text)
        yield text[at:end]
        at = end


class Encoder:
    """Ids of whole texts.

    A tokenizer that lowers its words, drops white space and marks word ends never joins across white space: many
    texts are split into chunks between blanks, and each different one is looked at once. A plain Latin word, with
    or without marks after it, goes straight to the library's word model, many new words in one call,
    without the steps that leave them unchanged; other chunks are encoded whole. Ids of words are remembered, as long
    as these are not too many or too long. Any other tokenizer gets the texts as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        steps = [repr(self.tokenizer.normalizer), repr(self.tokenizer.pre_tokenizer)]
        self.by_word = "Lowercase" in steps[0] and "Removed" in steps[1] and "ByteLevel" in steps[1] and bool(
            getattr(model, "end_of_word_suffix", None))
        self.words = Tokenizer(model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._empty()

    def _empty(self) -> None:
        self.known, self.chars = Remembered(), 0
        self.ids, self.ends, self.again = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.ones(1, bool)

    def _forget(self) -> None:
        """Keep the words met in more than one group of texts since the last time, or none if these come near the limit."""
        words = [w for w, again in zip(self.known, self.again.tolist()) if again]
        chars = sum(map(len, words))
        if 4 * len(words) > 3 * REMEMBERED or 4 * chars > 3 * REMEMBERED_CHARS:
            return self._empty()
        self.ids, self.ends = gathered(self.ids, self.ends, np.flatnonzero(self.again))
        self.known, self.chars = Remembered(words), chars
        self.again = np.arange(len(words)) == 0

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lower words and of marks, and how many each has; in groups, as the library holds much for each word."""
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(words), WORDS):
            group = words[at:at + WORDS]
            found = self.words.encode(" ".join(group), add_special_tokens=False)
            ids.append(np.array(found.ids, "<u4"))
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(group)))
        return np.concatenate(ids), np.concatenate(counts)

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """Two numbers for each chunk: its word and the marks behind, or the whole chunk and nothing."""
        words = pc.utf8_rtrim(chunks, characters=MARKS)
        plain = pc.equal(pc.utf8_ltrim(words, characters=LETTERS), "")
        low = pc.utf8_lower(words.filter(plain)).dictionary_encode()
        marks = pc.utf8_ltrim(chunks.filter(plain), characters=LETTERS).dictionary_encode()
        known, before, out = self.known, len(self.known), np.zeros((len(chunks), 2), np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        for column, part in enumerate((low, marks)):
            numbers = np.array([known[w] for w in part.dictionary.to_numpy(zero_copy_only=False)], np.int64)
            out[plain, column] = numbers[part.indices.to_numpy()]
        ids, counts = self._of_words(known.new)
        self.chars += sum(map(len, known.new))
        known.new = []
        out[~plain, 0] = [known[c] for c in chunks.filter(pa.array(~plain)).to_pylist()]
        wholes = [self._whole(c) for c in known.new]
        self.chars += sum(map(len, known.new))
        known.new = []
        counts = np.concatenate([counts, [len(w) for w in wholes]]).astype(np.int64)
        self.again[out[out < before]] = True
        self.again = np.concatenate([self.again, np.zeros(len(counts), bool)])
        self.ids = np.concatenate([self.ids, ids, *wholes])
        self.ends = np.concatenate([self.ends, self.ends[-1] + counts.cumsum()])
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if len(self.known) != len(self.ends):  # a call before failed and left words without ids
            self._empty()
        elif len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        chunks = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        different = chunks.flatten().dictionary_encode()
        numbers = self._numbers(different.dictionary).reshape(-1)
        ids, ends = gathered(self.ids, self.ends, numbers)
        ids, ends = gathered(ids, ends[1::2], different.indices.to_numpy())
        ends = np.concatenate([[0], ends])[chunks.value_lengths().to_numpy().cumsum()].tolist()
        return [ids[at:end].tobytes() for at, end in zip([0, *ends], ends)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as bytes. Texts are worked on PART characters at a time, a longer one in parts."""
        if not self.by_word:
            yield from (self._whole(t or "").tobytes() for t in texts)
            return
        group, chars = [], 0
        for text in texts:
            text = text or ""
            if group and chars + len(text) > PART:
                yield from self._encoded(group)
                group, chars = [], 0
            if len(text) > PART:
                yield b"".join([ids for part in parts_of(text) for ids in self._encoded([part])])
            else:
                group.append(text)
                chars += len(text)
        if group:
            yield from self._encoded(group)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def worker_encoder(path: str) -> Encoder:
    """The encoder of this worker process: the tasks that follow in it find the chunks that earlier ones have met.

    Functions travel by value and have no module of their own in a worker, so the place is a module made for it.
    """
    place = sys.modules.setdefault("threadwise_worker", ModuleType("threadwise_worker"))
    held = vars(place).setdefault("encoders", {})
    if path not in held:
        held.clear()  # one at a time: an encoder remembers much
        held[path] = Encoder(path)
    return held[path]


def encoded_blocks(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   block: int = BLOCK, layout: str = "byte") -> DataFrame:
    """Blocks of the ids of all documents in ascending id order, END_ID after each document.

    Documents are range-sorted by id (null first, equal ids by their text's key); each range becomes one shard, whose
    number is its place in the order. doc_row numbers the documents of a shard, so repeated rows stay apart.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_encoder(tokenizer)
        press = zstandard.ZstdCompressor(level=LEVEL)
        end = np.array([END_ID], "<u4").tobytes()
        parts: list[bytes] = []
        pieces: list[tuple[int, int | None, int]] = []
        state = {"room": block, "chunk": 0, "row": 0}

        def close(shard: int) -> pd.DataFrame:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [shard, state["chunk"], state["chunk"] * block, len(ids), layout,
                   [press.compress(p) for p in planes_of(ids, layout)], *map(list, zip(*pieces))]
            parts.clear()
            pieces.clear()
            state.update(room=block, chunk=state["chunk"] + 1)
            return pd.DataFrame([row], columns=[c.split()[0] for c in FILE_SCHEMA.split(", ")])

        shard = 0
        for batch in batches:
            found = encoder.encode_all(batch["text"].tolist())
            for shard, none, key, ids in zip(*[batch[c].tolist() for c in ("shard", "none", "key")], found):
                id_, data, at = None if none else key, ids + end, 0
                while at < len(data):
                    n = min(len(data) - at >> 2, state["room"])
                    parts.append(data[at:at + 4 * n])
                    pieces.append((state["row"], id_, n))
                    at += 4 * n
                    state["room"] -= n
                    if not state["room"]:
                        yield close(shard)
                state["row"] += 1
        if parts:
            yield close(shard)

    conf = docs.sparkSession.conf
    if int(conf.get(READER_ROWS)) > SCANNED:
        conf.set(READER_ROWS, str(SCANNED))
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       text_key(F.col(text_col)).alias("key"))
    ranged = rows.repartitionByRange("id", "key").sortWithinPartitions("id", "key")
    return ranged.select(F.spark_partition_id().alias("shard"), *split_id(F.col("id")), "text").mapInPandas(run, FILE_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, block: int = BLOCK, layout: str = "byte",
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the blocks below path, by Spark's committer: a lost task leaves no half file.

    A record is one block: its place (shard, chunk, first id), number of ids and layout are the chunk index, which a
    reader can scan without the planes; each plane is a zstandard frame of its own. doc_row, doc_id and doc_ids list
    the documents with ids in the block, in order, and how many.
    """
    encoded_blocks(docs, tokenizer, id_col, text_col, block, layout).write.option(
        "compression", "uncompressed").parquet(path)


def read_ids(record) -> np.ndarray:
    """Ids of one record."""
    unpress = zstandard.ZstdDecompressor()
    return ids_of([unpress.decompress(p) for p in record["planes"]], record["n_ids"], record["layout"])


def times_x(value: int, powers: int) -> int:
    """value times x to the powers, modulo the polynomial of crc32 (bits reversed)."""
    def product(a: int, b: int) -> int:
        out = 0
        while b:
            if b & 0x80000000:
                out ^= a
            b = b << 1 & 0xFFFFFFFF
            a = a >> 1 ^ (POLYNOMIAL if a & 1 else 0)
        return out

    base = 0x40000000
    while powers:
        if powers & 1:
            value = product(value, base)
        base, powers = product(base, base), powers >> 1
    return value


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of consecutive parts, each given as (bytes, crc32)."""
    total = 0
    for n, crc in parts:
        total = times_x(total, 8 * n) ^ crc
    return total


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files below path, decoded from the blocks.

    start counts the ids of all documents before. Blocks are decoded one by one; the checksum of a document in several
    blocks is joined from those of its parts. No files' rows: an empty table.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                data, at = read_ids(record).tobytes(), 0
                for row, none, key, n in zip(*[record[c] for c in ("doc_row", "none", "key", "doc_ids")]):
                    out.append((record["shard"], row, none, key, record["first"] + at // 4, n, crc32(data[at:at + 4 * n])))
                    at += 4 * n
            yield pd.DataFrame(out, columns=["shard", "row", "none", "key", "at", "n", "crc"])

    def join(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lists:
            yield pd.Series([
                x[0]["crc"] if len(x) == 1 else joined_crc([(4 * p["n"], p["crc"]) for p in x]) for x in batch],
                dtype="int64")

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    named = files.withColumns({"none": F.transform("doc_id", F.isnull), "key": F.transform(
        "doc_id", lambda x: F.coalesce(x, F.lit(0)))}).drop("doc_id")
    pieces = named.mapInPandas(run, "shard int, row long, none boolean, key long, at long, n long, crc long")
    docs = pieces.withColumn("doc_id", F.expr(JOINED_ID)).groupBy("shard", "row", "doc_id").agg(
        F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    # One row per file: bounded by the number of tasks that wrote them.
    shards = files.groupBy("shard").agg(F.max(F.col("first") + F.col("n_ids")).alias("n"))
    starts = shards.select("shard", F.coalesce(F.sum("n").over(
        W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return docs.join(starts, "shard").select(
        "doc_id", (F.col("base") + F.col("parts")[0]["at"]).alias("start"), "n_tokens",
        F.pandas_udf(join, "long")("parts").alias("ids_crc32"))
