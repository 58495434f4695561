"""Removal of repeated passages: paragraphs joined by MinHash bands, sentences and chosen windows by their words."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from threadwise.llm.components import connected_components
from threadwise.llm.repetition import (
    BYTE_FACTOR, BYTE_VALUES, SLICE_BYTES, Powers, Rolling, text_bytes, word_bounds,
)
from threadwise.llm.shared import drop_stored, fresh, in_small_batches, stored, text_key, with_row_key

SHINGLE = 5
SIMILARITY = 0.8
#: Hash functions of a signature and the share of pairs at the similarity that a common band must find.
HASHES, RECALL = 30, 0.999
#: Words of a paragraph that takes part in the bands, of a sentence, and of a passage worth removing.
PARAGRAPH_WORDS, SENTENCE_WORDS, PASSAGE_WORDS = 20, 8, 20
#: A longer sentence is cut at words chosen by their hash, so that copies are cut alike.
LONG_SENTENCE = 48
#: Words of a window, and how many neighbouring windows there are for each one that is chosen: a run of
#: WINDOW_WORDS + CHOICE - 1 words holds a chosen one, the same wherever the run stands. The run goes on for less than
#: CHOICE words beyond its outer ones.
WINDOW_WORDS, CHOICE = 20, 31
#: Paragraphs that a task compares at once; a larger group is compared block by block.
BLOCK = 512
PRIME = np.uint64((1 << 61) - 1)


def tuned_bands(hashes: int = HASHES, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the most rows a band may have so that a pair at the similarity shares a band with the recall."""
    rows = max(r for r in range(1, hashes + 1) if r == 1 or 1 - (1 - similarity ** r) ** (hashes // r) >= recall)
    return hashes // rows, rows


class Codes(dict):
    """Hash of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def shingles(codes: np.ndarray) -> np.ndarray:
    """Hash of each run of SHINGLE words, also those that cross a line."""
    out = np.zeros(max(0, len(codes) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        out = mixed(out ^ codes[i:len(codes) - SHINGLE + 1 + i])
    return out


def sentences(codes: np.ndarray, line_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the sentences: cut at stops and line ends, and long ones at words chosen by their hash."""
    cut = (codes & np.uint64(1)).astype(bool)
    cut[line_ends - 1] = True
    ends = np.flatnonzero(cut) + 1
    sizes = np.diff(ends, prepend=0)
    if sizes.max(initial=0) > LONG_SENTENCE:
        cut |= np.repeat(sizes > LONG_SENTENCE, sizes) & ((codes >> np.uint64(7)) & np.uint64(15) == 0)
        ends = np.flatnonzero(cut) + 1
    return np.concatenate(([0], ends[:-1])), ends


def sliding(least_or_most, values: np.ndarray, n: int) -> np.ndarray:
    """The least or most of each n neighbours."""
    held = 1
    while held < n:
        step = min(held, n - held)
        values = least_or_most(values[:-step], values[step:])
        held += step
    return values


def chosen_windows(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that have the least hash of CHOICE neighbours (winnowing), whatever the lines.

    text is the number of each word's text; no window and no neighbours cross texts.
    """
    most = WINDOW_WORDS + CHOICE - 1
    if len(codes) < most:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts, n = shingles(codes), len(codes) - WINDOW_WORDS + 1
    hashed = np.zeros(n, np.uint64)
    for i in range(0, WINDOW_WORDS, SHINGLE):
        hashed = mixed(hashed ^ parts[i:i + n])
    least = sliding(np.minimum, hashed, CHOICE)
    least[text[:len(least)] != text[most - 1:]] = 0
    edge = np.zeros(CHOICE - 1, np.uint64)
    at = np.flatnonzero(sliding(np.maximum, np.concatenate((edge, least, edge)), CHOICE) == hashed)
    return at, hashed[at]


class Signer:
    """Band keys of paragraphs."""

    def __init__(self, hashes: int, similarity: float, recall: float):
        self.bands, self.rows = tuned_bands(hashes, similarity, recall)
        rng = np.random.default_rng(11)
        self.a = rng.integers(1, 1 << 62, self.bands * self.rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 62, self.bands * self.rows, dtype=np.uint64)

    def keys(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(paragraphs, bands) keys of the shingles, laid out paragraph after paragraph from the starts on."""
        mins = np.stack([np.minimum.reduceat((values * a + b) >> np.uint64(16), starts) for a, b in zip(self.a, self.b)], 1)
        out = np.zeros((len(starts), self.bands), np.uint64)
        for r in range(self.rows):
            out = (out ^ mins[:, r::self.rows]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(31)
        out = (out ^ np.arange(self.bands, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return np.maximum(out, np.uint64(1)).view(np.int64)  # 0 stands for no key


@dataclass(frozen=True)
class Units:
    """Units of some texts as arrays: paragraphs (kind 1) first, then sentences (kind 0) and windows (kind 2).

    start counts the words of the text before the unit. key is the hash of the paragraph, or of the words of the sentence
    or window. before is the running hash of the text's words up to the unit; last and last_before are start and before of
    the same sentence's or window's place before this one in the same text, last is -1 for the first place and for
    paragraphs. bands has a row for each paragraph.
    """

    text: np.ndarray
    start: np.ndarray
    words: np.ndarray
    kind: np.ndarray
    key: np.ndarray
    before: np.ndarray
    last: np.ndarray
    last_before: np.ndarray
    bands: np.ndarray


#: Odd factor of the running hash of words, and its inverse modulo 2^64.
FACTOR = 0xD1342543DE82EF95
BACK = np.uint64(pow(FACTOR, -1, 1 << 64))


@dataclass(frozen=True)
class Words:
    """Words of some texts, A-Z in lower case, and their lines: codes holds a hash of each word whose last bit tells
    whether it ends a sentence; text, start (words of the text before it), size and key describe each line with a word."""

    codes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    key: np.ndarray


BY_BYTE = Powers(BYTE_FACTOR)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(texts: pa.Array) -> Words:
    data, text_ends = text_bytes(texts)
    data = LOWER[data]
    starts, ends = word_bounds(data, text_ends)
    rolling = Rolling(BYTE_VALUES[data], BY_BYTE)
    stops = np.isin(data[ends - 1], list(b".!?"))
    codes = rolling.of(starts, ends) & ~np.uint64(1) | stops.astype(np.uint64)
    text = np.searchsorted(text_ends, starts, "right")
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    size = np.diff(at, append=len(starts))
    before = np.searchsorted(text, text[at])  # words of the texts before
    return Words(codes, text[at], at - before, size, rolling.of(starts[at], ends[at + size - 1]))


def units_of(texts: pa.Array, signer: Signer) -> Units | None:
    w = words_of(texts)
    codes, doc, start, size, key = w.codes, w.text, w.start, w.size, w.key
    if not len(codes):
        return None
    line_end = np.cumsum(size)
    line_start = line_end - size

    begin, end = sentences(codes, line_end)
    place = np.arange(len(codes)) - np.repeat(begin, end - begin)
    hashed = mixed(np.add.reduceat(mixed(codes + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), begin))
    line = np.searchsorted(line_end, begin, "right")
    long_ = end - begin >= SENTENCE_WORDS
    begin, end, hashed, line = begin[long_], end[long_], hashed[long_], line[long_]

    whole = np.flatnonzero(size >= PARAGRAPH_WORDS)
    own = np.zeros(len(codes), bool)
    for a, b in zip(line_start[whole].tolist(), line_end[whole].tolist()):
        own[a:b - SHINGLE + 1] = True
    counts = size[whole] - SHINGLE + 1
    values = shingles(codes)[own[:len(codes) - SHINGLE + 1]]
    bands = signer.keys(values, np.cumsum(counts) - counts) if len(whole) else np.zeros((0, signer.bands), np.int64)

    window, content = chosen_windows(codes, np.repeat(doc, size))
    line = np.concatenate((whole, line, np.searchsorted(line_end, window, "right")))
    at = np.concatenate((line_start[whole], begin, window))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * np.cumprod(
        np.concatenate((np.ones(1, np.uint64), np.full(len(codes) - 1, FACTOR, np.uint64))), dtype=np.uint64))))
    inside = start[line] + at - line_start[line]
    first = at - inside  # where the unit's text begins
    kind = np.repeat([1, 0, 2], [len(whole), len(end), len(window)])
    unit = np.concatenate((key[whole], hashed, content)).view(np.int64)
    before = ((sums[at] - sums[first]) * BACK ** first.astype(np.uint64)).view(np.int64)
    last, last_before, own = np.full(len(at), -1), np.zeros(len(at), np.int64), doc[line]
    order = np.lexsort((at[len(whole):], unit[len(whole):], own[len(whole):])) + len(whole)
    again = np.flatnonzero((unit[order[1:]] == unit[order[:-1]]) & (own[order[1:]] == own[order[:-1]]))
    last[order[again + 1]], last_before[order[again + 1]] = inside[order[again]], before[order[again]]
    return Units(own, inside, np.concatenate((size[whole], end - begin, np.full(len(window), WINDOW_WORDS))),
                 kind, unit, before, last, last_before, bands)


def same_stretch(start: np.ndarray, before: np.ndarray, head_start: np.ndarray, head_before: np.ndarray) -> np.ndarray:
    """Whether the words from each place to the next one are those between the heads' places, by their running hashes."""
    stretch = lambda s, b: (b[1:] - b[:-1]) * BACK ** s[:-1].astype(np.uint64)
    return stretch(start, before.view(np.uint64)) == stretch(head_start, head_before.view(np.uint64))


def in_slices(batches: Iterator[pa.RecordBatch], signer: Signer) -> Iterator[tuple[pa.RecordBatch, Units]]:
    for part in small_parts(batches):
        found = units_of(part.column("text"), signer)
        if found:
            yield part, found


def small_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE_BYTES of text at most, or of one longer text."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def repeated_keys(docs: DataFrame, signer: Signer) -> DataFrame:
    """(unit) keys of the units at two places or more, and of the bands of two places of different paragraphs or more.

    Only keys and their numbers go into the shuffle, added up in each task first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, u in in_slices(batches, signer):
            _, different = np.unique(u.key[:len(u.bands)], return_index=True)
            keys, n = np.unique(np.concatenate((u.key, u.bands[different].ravel())), return_counts=True)
            yield pa.RecordBatch.from_pydict({"unit": keys, "n": n})

    keys = in_small_batches(docs).select("text").mapInArrow(run, "unit long, n long")
    return keys.groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1").select("unit")


UNITS = ("id long, thash long, start int, words int, kind int, unit long, before long, last int, last_before long, "
         "bands array<long>")


def units(docs: DataFrame, signer: Signer, mask: np.ndarray) -> DataFrame:
    """(id, thash, start, words, kind, unit, before, last, last_before, bands) of the units whose key the mask lets through, and of the
    paragraphs with such a band; bands is filled for paragraphs only, with 0 for the others."""
    sent = docs.sparkSession.sparkContext.broadcast(mask)

    def let_through(keys: np.ndarray) -> np.ndarray:
        at = keys & (MASK_BITS - 1)
        return (sent.value[at >> 3] >> (at & 7) & 1).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, u in in_slices(batches, signer):
            n = len(u.bands)
            bands = np.where(let_through(u.bands), u.bands, 0)
            open_ = let_through(u.key)
            open_[:n] |= bands.any(1)
            at = np.flatnonzero(open_)
            paragraphs = int(open_[:n].sum())
            offsets = np.minimum(np.arange(len(at) + 1), paragraphs) * signer.bands
            owner = pa.array(u.text[at])
            yield pa.RecordBatch.from_arrays([
                part.column("id").take(owner), part.column("thash").take(owner).cast(pa.int64()), pa.array(u.start[at], pa.int32()),
                pa.array(u.words[at], pa.int32()), pa.array(u.kind[at], pa.int32()), pa.array(u.key[at]),
                pa.array(u.before[at]), pa.array(u.last[at], pa.int32()), pa.array(u.last_before[at]),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands[at[:paragraphs]].ravel()))],
                names=[c.split()[0] for c in UNITS.split(", ")])

    return in_small_batches(docs).mapInArrow(run, UNITS)


#: Bits of the mask that keeps unwanted paragraphs from being cut into shingles: 8 MB, whatever the input.
MASK_BITS = 1 << 26


def wanted_mask(unit: DataFrame) -> np.ndarray:
    """Bytes of a bitmap with the bits of the units set; a bit may stand for several, so it only sorts out."""
    bit = F.pmod(F.col("unit"), F.lit(MASK_BITS)) + 1
    maps = unit.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    mask = np.zeros(MASK_BITS // 8, np.uint8)
    for row in maps.collect():  # at most MASK_BITS / 32768 rows of 4 KB
        at = (row["bucket"] - 1) * 4096
        mask[at:at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return mask


def paragraph_sets(docs: DataFrame, mask: np.ndarray) -> DataFrame:
    """(unit, shingles) of the paragraphs that the mask lets through: their different shingles' hashes, sorted, as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in small_parts(batches):
            w = words_of(batch.column("text"))
            at = (w.key & np.uint64(MASK_BITS - 1)).view(np.int64)
            open_ = (bits[at >> 3] >> (at & 7) & 1).astype(bool) & (w.size >= PARAGRAPH_WORDS)
            keys, which = np.unique(w.key[open_], return_index=True)
            ends = np.cumsum(w.size)[open_][which]
            starts = ends - w.size[open_][which]
            sets = [np.unique(shingles(w.codes[a:b])).tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_pydict({"unit": keys.view(np.int64), "shingles": pa.array(sets, pa.binary())})

    return docs.select("text").mapInArrow(run, "unit long, shingles binary")


def similar_links(similarity: float):
    """Links joining the similar paragraphs of each group, verified by the exact Jaccard similarity of their shingles.

    A pair is compared in the first of the bands that it shares only.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            group = rows["group"].to_numpy()
            ends = (np.flatnonzero(group[1:] != group[:-1]) + 1).tolist()
            last = ends[-1] if ends else 0
            if last:
                yield links(rows.iloc[:last], ends)
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield links(held, [len(held)])

    def links(rows: pd.DataFrame, ends: list[int]) -> pd.DataFrame:
        unit, block, band = rows["unit"].tolist(), rows["block"].tolist(), rows["band"].iloc[:].tolist()
        sets, bands = rows["shingles"].tolist(), np.stack(rows["bands"].tolist())
        found, start = [], 0
        for end in ends:
            found += forest(start, end, unit, block, band[start], sets, bands)
            start = end
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    def forest(start, end, unit, block, band, sets, bands) -> list[tuple[int, int]]:
        values = [np.frombuffer(s, np.uint64) for s in sets[start:end]]
        sizes = np.array([len(v) for v in values])
        crossing = len(set(block[start:end])) > 1  # pairs inside a block belong to the block's own cell
        inside = np.array(block[start:end])
        parent, found = list(range(end - start)), []

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i in range(1, end - start):
            same = (bands[start:start + i] == bands[start + i]) & (bands[start + i] != 0)
            shared = bands[start + i][same.argmax(1)] == band
            near = np.minimum(sizes[:i], sizes[i]) >= similarity * np.maximum(sizes[:i], sizes[i])
            open_ = shared & near & (inside[:i] != inside[i]) if crossing else shared & near
            for j in np.flatnonzero(open_).tolist():
                if top(i) == top(j):
                    continue
                common = len(np.intersect1d(values[i], values[j], assume_unique=True))
                if common >= similarity * (len(values[i]) + len(values[j]) - common):
                    parent[top(i)] = top(j)
                    found.append((unit[start + i], unit[start + j]))
        return found

    return run


def paragraph_links(found: DataFrame, docs: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b) links between the different paragraphs of similarity or more that share a band, enough to join them.

    Every two members of a band are compared. A band of over `block` paragraphs is laid out as a grid of blocks, a
    task for each two of them; nothing is left out, and only a spanning forest of each comparison goes on.
    """
    # Equal paragraphs have equal bands.
    index = found.where("kind = 1").groupBy("unit").agg(F.min("bands").alias("bands"))
    index = stored(index, "signed")
    entries = index.select("unit", F.explode("bands").alias("band")).where("band <> 0")
    sizes = entries.groupBy("band").count().where("count > 1").withColumn(
        "blocks", F.ceil(F.col("count") / block).cast("int"))
    members = entries.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    cells = members.select("unit", "band", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = stored(cells.select(
        "unit", "band", F.col("own").alias("block"),
        F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")).alias("group")), "cells")
    wanted = cells.select("unit").distinct().join(index, "unit")
    sets = paragraph_sets(docs, wanted_mask(wanted)).join(wanted, "unit").groupBy("unit", "bands").agg(
        F.min("shingles").alias("shingles"))
    return (
        cells.join(sets, "unit").repartition("group").sortWithinPartitions("group", "unit")
        .mapInPandas(similar_links(similarity), "a long, b long"))


#: Key of a document without nulls, and that of the document where a repeat stays.
KEY = ["none", "key", "thash"]
HEAD_KEY = [f"head_{k}" for k in KEY]


def own_key(id_col: str, thash: str, prefix: str = "") -> list:
    return [F.col(id_col).isNull().alias(prefix + "none"), F.coalesce(F.col(id_col), F.lit(0)).alias(prefix + "key"),
            F.col(thash).alias(prefix + "thash")]


def surroundings(places: DataFrame, docs: DataFrame) -> DataFrame:
    """The places (KEY, start, end) with hashes of the CHOICE - 1 words before, nearest first, and of those after."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for batch in batches:
            out = []
            for none, key, thash, text, spans in batch.itertuples(index=False):
                words = text.encode().lower().split()
                for s in spans:
                    start, end = s["start"], s["end"]
                    before, after = words[max(0, start - CHOICE + 1):start][::-1], words[end:end + CHOICE - 1]
                    out.append((none, key, thash, start, end, *(
                        (codes.of(w) >> np.uint64(33)).astype(np.int32) for w in (before, after))))
            yield pd.DataFrame(out, columns=[*KEY, "start", "end", "before", "after"])

    texts = in_small_batches(docs).select(*own_key("id", "thash"), "text")
    wanted = places.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = texts.join(wanted, KEY).select(*KEY, "text", "spans").mapInPandas(
        run, "none boolean, key long, thash long, start int, end int, before array<int>, after array<int>")
    return found.dropDuplicates([*KEY, "start", "end"])  # of equal rows


PARTS = ("none boolean, key long, thash long, head_none boolean, head_key long, head_thash long, own boolean, shift int, "
         "start int, end int")


def joined_parts(repeats: DataFrame) -> DataFrame:
    """(KEY, HEAD_KEY, own, shift, start, end) of the repeats of one text at one distance from their pattern, joined to runs
    where the words from one to the next are those of the pattern, too. A task sorts the places of the texts it holds."""
    order = [*KEY, *HEAD_KEY, "own", "shift", "start"]
    names = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            cut = new_parts(rows)
            last = int(np.flatnonzero(cut)[-1])  # the last run may go on in the next batch
            yield from runs(rows.slice(0, last), cut[:last])
            held = rows.slice(last)
        if held is not None:
            yield from runs(held, new_parts(held))

    def new_parts(rows: pa.Table) -> np.ndarray:
        values = {c: rows.column(c).to_numpy() for c in (*order, "before", "pattern_before")}
        new = np.ones(len(rows), bool)
        new[1:] = np.logical_or.reduce([values[c][1:] != values[c][:-1] for c in order[:-1]])
        new[1:] |= ~same_stretch(values["start"], values["before"], values["start"] + values["shift"], values["pattern_before"])
        return new

    def runs(rows: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            at = np.flatnonzero(new)
            first = rows.take(pa.array(at)).set_column(
                rows.schema.get_field_index("end"), "end",
                pa.array(np.maximum.reduceat(rows.column("end").to_numpy(), at), pa.int32()))
            yield from first.select(names).combine_chunks().to_batches()

    ranged = repeats.repartition(*KEY, *HEAD_KEY).sortWithinPartitions(*order)
    return ranged.select(*names, "before", "pattern_before").mapInArrow(run, PARTS)


def extended(repeats: DataFrame, docs: DataFrame) -> DataFrame:
    """(KEY, start, end, HEAD_KEY) of the repeats in their full length: joined where the words between them agree, and as
    far as the words before and after them are those of the pattern, too.

    The pattern is the same text's place before (own), or the head where there is none. Where a text repeats itself at a
    distance of less than a window (`a a a`), its first window stays.
    """
    pattern = [f"pattern_{k}" for k in KEY]
    parts = joined_parts(repeats).withColumns({
        p: F.when(F.col("own"), F.col(k)).otherwise(F.col(h)) for p, k, h in zip(pattern, KEY, HEAD_KEY)})
    parts = stored(parts.withColumns({
        "pattern_start": F.col("start") + F.col("shift"), "pattern_end": F.col("end") + F.col("shift")}), "parts")
    place = [*KEY, "start", "end"]
    other = [f"pattern_{c}" for c in place]
    first = parts.select(*[F.col(o).alias(c) for o, c in zip(other, place)])
    around = stored(surroundings(parts.select(*place).unionByName(first).distinct(), docs), "surroundings")

    def agreeing(side: str):
        same = F.zip_with(side, f"pattern_{side}", lambda a, b: a.eqNullSafe(b))
        apart = F.array_position(same, False)
        return F.when(apart == 0, F.size(same)).otherwise(apart - 1).cast("int")

    both = parts.join(around, place).join(around.toDF(*[f"pattern_{c}" for c in around.columns]), other)
    both = both.withColumns({"start": F.col("start") - agreeing("before"), "end": F.col("end") + agreeing("after")})
    itself = (F.col("none") == F.col("pattern_none")) & (F.col("key") == F.col("pattern_key")) & (
        F.col("thash") == F.col("pattern_thash"))
    return both.withColumn("start", F.when(
        itself, F.greatest(F.col("start"), F.col("start") + F.col("shift") + WINDOW_WORDS)).otherwise(F.col("start"))
    ).where("start < end").select(*KEY, "start", "end", *HEAD_KEY)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                      hashes: int = HASHES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Passages that repeat an earlier one: (doc_id, thash, start_word, n_words, kept_doc_ids), one row each.

    A paragraph is a line of the text. Paragraphs of at least 20 words that share a MinHash band and whose five-word
    shingles reach the Jaccard similarity form a cluster, by components; sentences of at least 8 words form one with
    their equals, and so do windows of 20 words chosen by their content, line ends ignored: any 50 words that stand at
    two places have a chosen window in common. The first member of a cluster in the order of (doc_id, text key,
    position) stays. The others are repeats; those of sentences and windows are extended word by word as far as the
    text agrees with that at the first member. Neighbouring repeats at most four words apart make up a passage, and
    passages of at least 20 words are returned. kept_doc_ids lists the documents whose text stays for
    it, null ids last in order and left out of the list. Null and empty texts have no passage. Repeated equal rows (id
    and text) count as one document. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("thash"),
                       F.col(text_col).alias("text"))
    signer = Signer(hashes, similarity, recall)
    found = stored(units(rows, signer, wanted_mask(repeated_keys(rows, signer))), "units")
    roots = connected_components(paragraph_links(found, rows, similarity, block)).toDF("unit", "root")
    first = F.struct(F.col("id").isNull().alias("last"), "id", "thash", "start", "before")
    member = found.select(
        "id", "thash", "start", "words", "kind", "unit", "before", "last", "last_before", first.alias("place"))
    # Classes by words first: copies combine before the shuffle. Two hashes tell whether there is another place.
    mark = F.xxhash64("id", "thash", "start")
    classes = member.groupBy("unit").agg(
        F.min("place").alias("first"), F.min(mark).alias("low"), F.max(mark).alias("high"), F.max("kind").alias("kind"))
    classes = stored(classes.where("kind = 1 or low <> high"), "classes")
    linked = classes.where("kind = 1").join(roots, "unit", "left").withColumn("class", F.coalesce("root", "unit"))
    heads = linked.groupBy("class").agg(F.min("first").alias("head"), F.min("low").alias("l"), F.max("high").alias("h"))
    heads = linked.join(heads.where("l <> h").select("class", "head"), "class").select("unit", "head")
    heads = stored(heads.union(classes.where("kind <> 1").select("unit", F.col("first").alias("head"))), "heads")
    repeats = member.join(heads, "unit").where("place <> head").select(
        *own_key("id", "thash"), "start", (F.col("start") + F.col("words")).alias("end"), "before",
        *own_key("head.id", "head.thash", "head_"), (own := F.col("last") >= 0).alias("own"),
        F.when(own, F.col("last_before")).otherwise(F.col("head.before")).alias("pattern_before"),
        (F.when(own, F.col("last")).otherwise(F.col("head.start")) - F.col("start")).alias("shift"),
        (F.col("kind") != 1).alias("exact"))
    repeats = stored(repeats, "repeats")
    for table in (found, classes, heads):
        drop_stored(table)
    spans = repeats.where("not exact").select(*KEY, "start", "end", *HEAD_KEY).unionByName(
        extended(repeats.where("exact"), rows))
    spans = spans.select(*KEY, "start", "end", F.when(~F.col("head_none"), F.col("head_key")).alias("kept")).distinct()
    own = W.partitionBy(*KEY).orderBy("start", "end", "kept")
    reach = F.max("end").over(own.rowsBetween(W.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce(F.col("start") > reach + 4, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(own))
    return (
        runs.groupBy(*KEY, "run")
        .agg(F.min("start").alias("start_word"), F.max("end").alias("end"), F.sort_array(F.collect_set("kept")).alias("kept_doc_ids"))
        .withColumn("n_words", F.col("end") - F.col("start_word")).where(F.col("n_words") >= PASSAGE_WORDS)
        .select(F.when(~F.col("none"), F.col("key")).alias("doc_id"), "thash", "start_word", "n_words", "kept_doc_ids"))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words from each start up to its end, their line breaks included."""
    kept, at, out = sorted(spans), 0, []
    for line in text.split("\n"):
        chunks = line.split(" ")
        held, cut = [], False
        for chunk in chunks:
            n = len(chunk.encode().split())
            gone = any(s <= at and at + n <= e for s, e in kept) and n > 0
            cut |= gone
            held += [] if gone else [chunk]
            at += n
        if held and (any(c for c in held) or not cut):
            out.append(" ".join(held))
    return "\n".join(out)


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without their repeated passages; one that has nothing but repeats is left out. Columns as they were.

    Texts without a passage stay as they are, white space included. Repeated equal rows count as one and come once.
    """
    passages = repeated_passages(docs, similarity=similarity)
    rows, key = with_row_key(docs, F.col("doc_id"), text_key(F.col("text")))
    spans, own = with_row_key(passages, F.col("doc_id"), F.col("thash"))
    name = fresh(docs, "spans")
    spans = spans.groupBy(*[F.col(o).alias(k) for o, k in zip(own, key)]).agg(F.collect_list(
        F.struct("start_word", (F.col("start_word") + F.col("n_words")).alias("end"))).alias(name))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, cuts in batches:
            yield pd.Series([t if c is None else without_words(t, [(x["start_word"], x["end"]) for x in c])
                             for t, c in zip(texts, cuts)], dtype=object)

    cut = F.pandas_udf(run, "string")(F.col("text"), F.col(name))
    joined = rows.dropDuplicates(key).join(spans, key, "left").withColumn("text", cut)
    return joined.where(F.col(name).isNull() | (F.length(F.trim("text")) > 0)).select(*docs.columns)
