"""Helpers of the operators in this subpackage."""

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadwise.session import scratch_dir

#: A word: a run without ASCII white space; the same pattern in Java and Python.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes and rows of texts that go to a Python worker at once, at most.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
ARROW = "spark.sql.execution.arrow"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def in_small_batches(docs: DataFrame) -> DataFrame:
    """The rows, in a session whose Arrow batches are bounded for texts: a worker and the JVM beside it hold a few
    megabytes of them at a time. A lower setting of the user's stays."""
    conf = docs.sparkSession.conf
    for key, most in ((f"{ARROW}.maxRecordsPerBatch", BATCH_ROWS), (f"{ARROW}.maxBytesPerBatch", BATCH_BYTES)):
        held = conf.get(key).rstrip("b")  # as set, or Spark's default in bytes
        if not held.isdigit() or not 0 < int(held) <= most:
            conf.set(key, str(most))
    return docs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the stored tables that are still in use.
STORED_AT: WeakKeyDictionary = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared scratch folder: computed once, lineage cut, readable from any executor."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the table holds the rows: the shuffle files behind it are needed no more
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    STORED_AT[table] = path
    return table


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a table made by `stored` that is read no more; any other table stays as it is."""
    path = STORED_AT.pop(df, None)
    if path:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def finite_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """The rows with a vector that is neither null nor empty and whose components are all there and finite."""
    vector = F.col(vector_col).cast("array<double>")
    return rows.where(vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def word_count(text):
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text):
    """64-bit key of a text; null and empty texts have the same one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def split_id(id_col) -> list:
    """A long id as two columns without nulls, none and key: pandas would make doubles of a long column that holds a
    null, which keep only 53 bits."""
    return [id_col.isNull().alias("none"), F.coalesce(id_col.cast("long"), F.lit(0)).alias("key")]


#: The id again from the columns of `split_id`, as an SQL expression.
JOINED_ID = "if(none, null, key)"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, id_col, thash) -> tuple[DataFrame, list[str]]:
    """The rows with the key of a document and the key's columns, none of them null: null ids last, the id, the text."""
    parts = {"id_null": id_col.isNull(), "id_key": F.coalesce(id_col.cast("long"), F.lit(0)), "text_key": thash}
    names = [fresh(df, n) for n in parts]
    return df.select("*", *[c.alias(n) for n, c in zip(names, parts.values())]), names
