"""Source adapters by name."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Fetched:
    """Raw rows of a fetch, and its warnings, if any (a column ``warning``)."""

    rows: DataFrame
    warnings: DataFrame | None = None


class SourceAdapter(ABC):
    """Reads raw rows (``schema.RAW``); ``seq`` must be a real key that orders an account's rows."""

    name = "base"
    #: What its rows say they are from; None: nothing, so they get the name under which the adapter runs.
    label: str | None = None

    @abstractmethod
    def read(self, spark: SparkSession, as_of: str, days_back: int) -> DataFrame: ...

    def fetch(self, spark: SparkSession, as_of: str, days_back: int, start_index: int = 0) -> Fetched:
        """The rows from ``start_index`` on, with warnings for what had to be left out."""
        rows = self.read(spark, as_of, days_back)
        return Fetched(rows.where(rows["seq"] >= start_index) if start_index else rows)

    def login(self) -> bool:
        """Before a fetch, and again where one fails for want of a login; whether an earlier session still served."""
        return False

    def is_auth_error(self, error: Exception) -> bool:
        return False

    def close(self) -> None:
        """Called once after a run, whatever its end."""


class UnknownSource(KeyError):
    """No adapter of this name."""


class Registry:
    """Names are the same in any case; the last registration of a name counts."""

    def __init__(self) -> None:
        self._classes: dict[str, type[SourceAdapter]] = {}

    def register(self, name: str, adapter: type[SourceAdapter]) -> None:
        self._classes[name.lower()] = adapter

    def create(self, name: str, *args: object, **options: object) -> SourceAdapter:
        if not self.has(name):
            raise UnknownSource(f"unknown source {name!r}; known: {', '.join(self.names()) or 'none'}")
        return self._classes[name.lower()](*args, **options)

    def resolve(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with ``source``: the registered name that ``column`` means, whatever its case; null for none."""
        name = F.lower(F.col(column))
        return rows.withColumn("source", F.when(name.isin(self.names() or [""]), name))

    def has(self, name: str) -> bool:
        return name.lower() in self._classes

    def names(self) -> list[str]:
        return list(self._classes)


registry = Registry()
