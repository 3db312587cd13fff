"""Registry of queries over the given tables and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job under a name, with the SQL of the same result if there is one."""

    def register(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"query {name} is registered twice")
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return register
