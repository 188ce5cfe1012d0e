"""All queries of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lecturelake.plans.bindings import Tables

_found: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the tables as a query, with its SQL."""

    def keep(f: Callable[[Tables], DataFrame]):
        if name in _found:
            raise ValueError(f"two queries named {name}")
        _found[name] = (f, sql)
        return f

    return keep


def _all() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    from lecturelake.plans import answer_queries, audio_queries, frame_queries, line_queries, pixel_queries, region_queries, stream_queries  # noqa: F401

    return _found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, path, f=f: f(Tables(spark, path))) for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["compare_board_speech"](spark, sf_dir)
