"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from roadlake.operators import datasets


def write_manifest(df: DataFrame, path: str, key: str, content: list[str], version: str) -> DataFrame:
    """A dataset version's manifest: rows and checksum, as JSON."""
    out = datasets.manifest(df, key, content, version)
    out.write.mode("overwrite").json(path)
    return out


def write_splits(samples: DataFrame, path: str) -> None:
    """A folder for each split, its files clustered so that no split has one from every task."""
    samples.repartition("split", "group_key").write.mode("overwrite").partitionBy("split").parquet(path)


def export_reports(reports: DataFrame, path: str, kind: str = "csv") -> None:
    """Reports for others, as csv or json. The format is a parameter: no document sets one."""
    if kind not in ("csv", "json"):
        raise ValueError("kind must be csv or json")
    writer = reports.write.mode("overwrite")
    (writer.option("header", "true").csv if kind == "csv" else writer.json)(path)


def write_evidence(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
