"""Registration of queries: a function of the views, and the SQL that must give the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselake.sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Rows and bytes of an Arrow batch at most, so that what a Python worker holds doesn't depend on the size of a partition or the length of its texts.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver was started from elsewhere, and keep Arrow batches small."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS_AT_ONCE:
        spark.conf.set(rows, ROWS_AT_ONCE)
    spark.conf.set(size, BYTES_AT_ONCE)
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if top not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (top, env.get("PYTHONPATH"))))


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Views(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return add
