"""Registry of the queries over the test tables and their SQL oracles."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from threadwise.plans.views import Tables, oracle_with


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def query(views: list[str] | None = None, oracle: str | None = None):
    """Register a function of Tables under its own name, with the SQL text that gives the same rows."""

    def register(run: Callable[[Tables], DataFrame]):
        assert run.__name__ not in REGISTRY, run.__name__
        text = oracle_with(views or [], oracle) if oracle else None
        REGISTRY[run.__name__] = Entry(run, text)
        return run

    return register


def _callable(entry: Entry, spread: int | None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: entry.run(Tables(spark, sf_dir, spread))


def queries(spread: int | None = None) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name; `spread` deals the rows of the text tables out over so many tasks."""
    return {name: _callable(entry, spread) for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.oracle for name, entry in REGISTRY.items() if entry.oracle}
