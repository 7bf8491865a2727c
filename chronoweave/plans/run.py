"""Running a job to its written results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from chronoweave.report import Report


def run_job(job: Callable[..., dict], *tables: DataFrame, into: str, **options) -> dict[str, DataFrame]:
    """Run a job that takes a ``report``, write each of its results to a folder of ``into`` and give them back, with ``report``."""
    report = Report()
    spark = tables[0].sparkSession
    out = {}
    for name, df in job(*tables, report=report, **options).items():
        df.write.mode("overwrite").parquet(f"{into}/{name}")
        out[name] = spark.read.schema(df.schema).parquet(f"{into}/{name}")
    return {**out, "report": report.table(spark)}
