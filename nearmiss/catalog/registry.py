"""Registered queries: name -> Spark job, optional DuckDB check, and the survey entries it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    job: Job
    check: str | None = None


ENTRIES: dict[str, Entry] = {}


def register(name: str, covers: str, job: Job, check: str | None = None) -> None:
    if name in ENTRIES:
        raise ValueError(f"query {name} registered twice")
    ENTRIES[name] = Entry(name, tuple(covers.split()), job, check)


def load_all() -> dict[str, Entry]:
    import importlib
    import pkgutil

    import nearmiss.catalog as catalog

    for module in pkgutil.iter_modules(catalog.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"nearmiss.catalog.{module.name}")
    return ENTRIES
