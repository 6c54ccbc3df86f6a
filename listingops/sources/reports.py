"""Writing reports and payload tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from listingops.operators.ledger import ordered, report


def report_name(now: datetime) -> str:
    return f"ledger_{now:%Y-%m-%d}"


def write_ledger(rows: DataFrame, folder: str, now: datetime) -> str:
    """The ledger report as CSV with a header below folder, in a folder that bears the date; returns its path.

    Rows stay in ledger order: the sort's partitions are written as files in order.
    """
    path = f"{folder.rstrip('/')}/{report_name(now)}"
    report(ordered(rows)).write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_payloads(payloads: DataFrame, folder: str) -> None:
    """The payload table, nested as it is, one directory for each platform."""
    payloads.write.mode("overwrite").partitionBy("platform").parquet(folder)
