"""Registry of queries: each name has a Spark callable and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, dates: str = ""):
    """Decorator: put a query into the catalog.

    ``dates`` names the result's date and timestamp columns; both engines return them as ISO text, so that
    results compare without regard to a client's date types.
    """

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            found = {c for c, kind in df.dtypes if kind in ("date", "timestamp", "timestamp_ntz")}
            if oracle is not None and found != set(dates.split()):
                raise ValueError(f"{name}: date columns are {sorted(found)}, declared {dates.split()}")
            return df.withColumns({c: df[c].cast("string") for c in sorted(found)}) if found else df

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split())
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({oracle.strip()})" if casts else oracle
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES


def _load() -> None:
    import importlib
    import pkgutil

    from eventide import plans

    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"eventide.plans.{m.name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["vol_realised_curve"](spark, sf_dir)
