"""A comment store in hash buckets of the key, changed by publishing new versions.

Below the store's folder, `data` has a folder for each write with one folder per bucket, and `versions` a small table for
each version that names the folder of every bucket. A version counts once Spark's committer has marked it complete, so a
job that dies before leaves the version before it as the one that readers see, and nothing is ever overwritten.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadwise.operators.merge import first_per_key

BUCKETS = 64
#: Changes that go to all tasks at once, at most: rows of a group of buckets. A bucket with more is joined by shuffle.
SENT_ROWS = 200_000
MANIFEST = "bucket INT, folder STRING"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/versions")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    complete = [n for n in names if files.exists(hadoop.Path(f"{path}/versions/{n}/_SUCCESS"))]
    return sorted(int(n) for n in complete)


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """Folder of each bucket: as many rows as there are buckets."""
    rows = spark.read.schema(MANIFEST).json(f"{path}/versions/{version}").collect()
    return {r["bucket"]: r["folder"] for r in rows}


def _publish(spark: SparkSession, path: str, version: int, folders: dict[int, str]) -> None:
    rows = spark.createDataFrame(sorted(folders.items()), MANIFEST).coalesce(1)
    # A version that was begun and never marked complete is written anew.
    rows.write.mode("overwrite").json(f"{path}/versions/{version}")


def _write(rows: DataFrame, path: str, folder: str) -> None:
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{folder}")


def create_store(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Store a table as version 0."""
    _write(rows.withColumn("bucket", bucket_of(key, buckets)).repartition(buckets, "bucket"), path, "0")
    _publish(rows.sparkSession, path, 0, {b: "0" for b in range(buckets)})


def read_store(spark: SparkSession, path: str, schema: str, version: int | None = None,
               buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version, by default the newest; of some buckets only if asked."""
    at = versions(spark, path)[-1] if version is None else version
    held = {b: f for b, f in manifest(spark, path, at).items() if buckets is None or b in buckets}
    reader, found = spark.read.schema(f"{schema}, bucket INT"), None
    # Buckets without a row have no folder: each write is read as a table of which some buckets count.
    for folder in sorted(set(held.values())):
        own = [b for b, f in held.items() if f == folder]
        part = reader.parquet(f"{path}/data/{folder}").filter(F.col("bucket").isin(own)).drop("bucket")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def grouped(counts: dict[int, int], most: int) -> list[list[int]]:
    """The touched buckets in groups whose changes are at most so many rows, or of one bucket."""
    groups: list[list[int]] = []
    size = 0
    for bucket, n in sorted(counts.items()):
        if not groups or size + n > most:
            groups.append([])
            size = 0
        groups[-1].append(bucket)
        size += n
    return groups


def change_store(spark: SparkSession, path: str, schema: str, changes: DataFrame, key: str, order: list[Column],
                 insert: bool = False, most: int = SENT_ROWS) -> int:
    """Publish a version with the changes and return its number.

    Of several changes of a key the first by `order` counts. An update sets the changed columns of stored rows, a null
    leaving the stored value; with `insert` the changes are whole rows that replace stored ones or are new, columns absent
    from them null. Only the buckets of changed keys are read and written again, group after group, and the stored rows
    of a group are not shuffled: its changes, counted first, go to every task. Without changes the version stays.
    """
    last = versions(spark, path)[-1]
    folders = manifest(spark, path, last)
    once = first_per_key(changes, key, order).withColumn("bucket", bucket_of(key, len(folders))).persist()
    try:
        counts = dict(once.groupBy("bucket").count().collect())  # a row for each touched bucket
        if not counts:
            return last
        for number, group in enumerate(grouped(counts, most)):
            own = once.filter(F.col("bucket").isin(group)).drop("bucket")
            if sum(counts[b] for b in group) <= most:
                own = F.broadcast(own)
            stored = read_store(spark, path, schema, last, group)
            rows = _replaced(stored, own, key) if insert else _updated(stored, own, key)
            folder = f"{last + 1}-{number}"
            _write(rows.withColumn("bucket", bucket_of(key, len(folders))), path, folder)
            folders |= {b: folder for b in group}
    finally:
        once.unpersist()
    _publish(spark, path, last + 1, folders)
    return last + 1


def _updated(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    columns = [c for c in changes.columns if c != key and c in stored.columns]
    renamed = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = stored.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*stored.columns)


def _replaced(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    same = stored[key].eqNullSafe(changes[key])
    return stored.join(changes, same, "left_anti").unionByName(changes, allowMissingColumns=True).select(*stored.columns)
