"""What a job left out or counted, gathered while its results are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROW = "step string, name string, value double, message string"


class Report:
    """Counts observed on tables on their way, and notes.

    ``watch`` attaches counts to a table; Spark takes them while the rows pass in the first action that reads it, so they cost no
    scan. It belongs on tables that are first read to their end. ``table`` gives the counts afterwards.
    """

    def __init__(self):
        self._seen: list[tuple[str, Observation, Callable[[dict], str] | None]] = []
        self._notes: list[tuple[str, str]] = []

    def watch(self, step: str, df: DataFrame, say: Callable[[dict], str] | None = None, **counts: Column) -> DataFrame:
        """The table with its counts observed; ``say`` makes a message of them, empty for none."""
        observation = Observation()
        self._seen.append((step, observation, say))
        return df.observe(observation, *[c.alias(n) for n, c in counts.items()])

    def note(self, step: str, message: str) -> None:
        self._notes.append((step, message))

    def table(self, spark: SparkSession) -> DataFrame:
        """``step, name, value, message``: a row for each count and each message. Call it when the results have been written."""
        rows = []
        for step, observation, say in self._seen:
            found = observation.get
            rows += [(step, n, None if v is None else float(v), None) for n, v in found.items()]
            if say is not None and (text := say(found)):
                rows.append((step, "warning", None, text))
        rows += [(step, "note", None, text) for step, text in self._notes]
        return spark.createDataFrame(rows, ROW)


def counted_filter(report: Report | None, step: str, df: DataFrame, keep: Column, what: str) -> DataFrame:
    """``df.filter(keep)``, with the rows before and after in the report."""
    if report is None:
        return df.filter(keep)
    kept = F.coalesce(keep, F.lit(False))

    def say(n: dict) -> str:
        left_out = n["rows"] - n["kept"]
        return f"{left_out} of {n['rows']} {what}" if left_out else ""

    return report.watch(step, df, say, rows=F.count(F.lit(1)), kept=F.count_if(kept)).filter(keep)
