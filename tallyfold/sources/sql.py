"""SQL over the active table, which is called data."""

from __future__ import annotations

from pyspark.sql import DataFrame


def run_sql(df: DataFrame, text: str) -> DataFrame:
    """The result of a query in which `data` stands for df; the view always is the current table."""
    df.createOrReplaceTempView("data")
    return df.sparkSession.sql(text)
