"""Order MinHash fingerprints, by array functions alone."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from threadwise.llm.shared import text_key

#: Words are cut into runs of at most so many characters, so that text without blanks has pieces too.
PIECE = r"[^\x20\x09-\x0D]{1,8}"
#: Pieces of a k-mer, tuples of a fingerprint, k-mers of a tuple.
K, TUPLES, TUPLE = 3, 64, 2
#: Bits of a position; the rest of a long is the hash.
POSITION = 27
#: Ranges of ids for each shuffle partition.
RANGES = 4


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def starts_of_runs(items: Column, key) -> Column:
    """Indexes at which the key changes in a sorted array, as an array that ends with the array's size."""
    def changes(i):
        return (i == 0) | (key(F.get(items, i)) != key(F.get(items, i - 1)))

    return F.concat(
        F.filter(F.sequence(F.lit(0), F.size(items) - 1), changes), F.array(F.size(items)))


def fingerprint(text: Column, k: int = K, tuples: int = TUPLES, length: int = TUPLE) -> Column:
    """Order MinHash of a text: an array of longs, tuple number in the high and signature in the low 32 bits.

    Every k-mer of the whole text gets its hash and its occurrence number among equal ones. The two are hashed again;
    the high bits of that hash deal the k-mers to the tuples, and each tuple takes its `length` least. They are put
    back into the order of the text and hashed together, so a signature changes with the k-mers, their counts and
    their order. A tuple without k-mers has no entry: short texts have few, null and empty ones none. A text of fewer
    than k pieces is one k-mer.
    """
    low = (1 << POSITION) - 1
    hash_of = lambda x: F.shiftrightunsigned(x, POSITION)
    place_of = lambda x: x.bitwiseAND(F.lit(low))
    pack = lambda h, place: F.shiftrightunsigned(h, POSITION + 1) * F.lit(1 << POSITION) + place
    bits = (tuples - 1).bit_length()

    def kmers(codes: Column) -> Column:
        n = F.greatest(F.size(codes) - (k - 1), F.least(F.size(codes), F.lit(1)))
        parts = lambda i: [F.get(codes, i + j) for j in range(k)]
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: pack(F.xxhash64(*parts(i)), i.cast("long")))))

    def numbered(kmer: Column) -> Column:
        return F.when(F.size(kmer) == 0, kmer).otherwise(let(starts_of_runs(kmer, hash_of), lambda starts: let(
            F.flatten(F.transform(F.sequence(F.lit(1), F.size(starts) - 1),
                                  lambda i: F.sequence(F.lit(0), starts[i] - starts[i - 1] - 1))),
            lambda occurrence: F.sort_array(F.transform(
                kmer, lambda x, i: pack(F.xxhash64(hash_of(x), occurrence[i]), place_of(x)))))))

    def signatures(ordered: Column) -> Column:
        number = lambda x: F.shiftrightunsigned(x, 63 - bits)
        least = F.filter(ordered, lambda x, i: (i < length) | (number(F.get(ordered, i - length)) != number(x)))
        back = lambda x: place_of(x) * F.lit(1 << 36) + hash_of(x)
        return F.when(F.size(ordered) == 0, ordered).otherwise(let(least, lambda kept: let(
            starts_of_runs(kept, number), lambda starts: F.transform(
                F.sequence(F.lit(1), F.size(starts) - 1),
                lambda i: number(kept[starts[i - 1]]) * F.lit(1 << 32) + F.xxhash64(F.transform(
                    F.sort_array(F.transform(F.slice(kept, starts[i - 1] + 1, starts[i] - starts[i - 1]), back)),
                    lambda x: x.bitwiseAND(F.lit((1 << 36) - 1)))).bitwiseAND(F.lit((1 << 32) - 1))))))

    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    codes = F.transform(pieces, lambda p: F.xxhash64(p))
    return let(codes, lambda c: let(kmers(c), lambda m: let(numbered(m), signatures)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the tuples in either fingerprint that have the same signature in both; 1 for two without tuples."""
    number = lambda x: F.shiftrightunsigned(x, 32)
    either = F.size(F.array_union(F.transform(a, number), F.transform(b, number)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def hexed(fingerprint_: Column) -> Column:
    """Ten hex digits a tuple."""
    return F.array_join(F.transform(fingerprint_, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def position(sorted_: Column, value: Column, n: int) -> Column:
    """Index of the last of n sorted items that is not above the value, by bisection; the first is not above it."""
    def halve(span, _):
        middle = F.floor((span["lo"] + span["hi"] + 1) / 2).cast("int")
        below = F.get(sorted_, middle) <= value
        return F.struct(F.when(below, middle).otherwise(span["lo"]).alias("lo"),
                        F.when(below, span["hi"]).otherwise(middle - 1).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), F.struct(
        F.lit(0).alias("lo"), F.lit(n - 1).alias("hi")), halve)["lo"]


def with_next(docs: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """The rows with next_<name> of the following row in the order of the keys; the first row follows the last.

    The keys alone are ranged first: one small row per range says where it begins. Then each row goes to its range by
    number, the first row of a range also to the range before, and a window inside the range does the rest, so the
    texts are shuffled once and a task holds a few ranges. Key columns must not be null.
    """
    order = F.struct(*keys)
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(*keys).repartitionByRange(ranges, *keys).select(order.alias("k"), F.spark_partition_id().alias("p"))
    found = ranged.groupBy("p").agg(F.min("k").alias("k")).orderBy("k").collect()  # a row for each range
    if not found:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    firsts = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r["k"].asDict().items()]) for r in found])
    n = len(found)
    own = lambda at: F.struct(at.alias("range"), F.lit(False).alias("ahead"))
    before = lambda at: F.struct(F.pmod(at - 1, F.lit(n)).alias("range"), F.lit(True).alias("ahead"))
    places = let(position(firsts, order, n), lambda at: F.when(
        F.get(firsts, at) == order, F.array(own(at), before(at))).otherwise(F.array(own(at))))
    window = W.partitionBy("place.range").orderBy("place.ahead", *keys)
    return docs.select("*", F.explode(places).alias("place")).select(
        "*", *[F.lead(c).over(window).alias(f"next_{c}") for c in carried]).where(~F.col("place.ahead")).drop("place")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    row's text in ascending id order; the first follows the last, and a single row follows itself. Null ids come
    first, equal ids in the order of their text's key. Null and empty texts have an empty fingerprint, like each other.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        F.col("doc_id").isNotNull().alias("k0"), F.coalesce("doc_id", F.lit(0)).alias("k1"), text_key(F.col("text")).alias("k2"),
        "doc_id", "text", fingerprint(F.col("text")).alias("mine"))
    pairs = with_next(rows, ["k0", "k1", "k2"], ["text", "mine"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "mine", "next_mine")
    out = out.withColumn("changed", fingerprint(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hexed(F.col("mine")).alias("fingerprint"), hexed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("changed")).alias("near_edited"),
        likeness(F.col("mine"), F.col("next_mine")).alias("near_next"))
