"""Table maintenance: inserts, replacements, updates and schema change as set operations."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from threadwise.operators.joins import null_safe_join
from threadwise.operators.ordering import top_per_group


def first_per_key(batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row of each key; rows equal in the order are told apart by a hash of the whole row."""
    return top_per_group(batch, [key], [*order, F.xxhash64(*batch.columns)], 1)


def new_rows(target: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The batch rows to append: those with keys that are not stored, the first of each."""
    absent = null_safe_join(batch, target.select(key), [key], "left_anti")
    return first_per_key(absent, key, order).select(*target.columns)


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Target plus the batch rows with new keys: stored rows stay, then the first row of the batch wins."""
    return target.unionByName(new_rows(target, batch, key, order))


def upsert_latest(target: DataFrame, batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last write of each key, whole rows replaced; columns absent in the batch become NULL.

    `sequence` orders the writes of the batch; any of them is later than the stored row. Only the batch is ordered:
    a stored row stays unless its key was written.
    """
    latest = first_per_key(batch, key, [F.desc(sequence)])
    kept = null_safe_join(target, latest.select(key), [key], "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True).select(*target.columns)


def apply_updates(target: DataFrame, updates: DataFrame, key: str, sequence: str | None = None) -> DataFrame:
    """Set the update columns on matching rows; a NULL in an update leaves the stored value.

    Of several updates of a key the last by `sequence` counts; of equal ones, or without it, the one of greater hash.
    """
    columns = [c for c in updates.columns if c != key]
    last = first_per_key(updates, key, [F.desc(sequence)] if sequence else [])
    renamed = last.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*target.columns)


def evolve_schema(old: DataFrame, schema: str, key: str, order: list[Column],
                  defaults: dict[str, Column]) -> DataFrame:
    """Old rows under a new schema by column name: absent columns get their default or NULL, first row per key."""
    kept = first_per_key(old, key, order)

    def value(field: StructField) -> Column:
        default = defaults.get(field.name, F.lit(None))
        column = F.coalesce(F.col(field.name), default) if field.name in kept.columns else default
        return column.cast(field.dataType).alias(field.name)

    return kept.select([value(field) for field in StructType.fromDDL(schema).fields])


def ingest_counts(target: DataFrame, batch: DataFrame, key: str, by: str) -> DataFrame:
    """Fetched, inserted and duplicate rows of a load, per group."""
    per_key = batch.groupBy(by, key).agg(F.count("*").alias("__copies"))
    known = per_key.join(target.select(key, F.lit(True).alias("__known")), key, "left")
    inserted = F.count_if(F.col("__known").isNull())
    fetched = F.sum("__copies")
    return known.groupBy(by).agg(
        fetched.alias("fetched"), inserted.alias("inserted"), (fetched - inserted).alias("duplicates")
    )
