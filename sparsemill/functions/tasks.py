"""How many tasks share the rows of an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task takes of an exchange by `dealt`.
ROWS_A_TASK = 1 << 18


def tasks(spark: SparkSession, bound: int | None) -> int:
    """The session's number of shuffle partitions, or more if that many rows at most ask for more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(bound or 0) // ROWS_A_TASK))


def dealt(df: DataFrame, bound: int | None, *keys: str) -> DataFrame:
    """df by keys over as many tasks as its rows ask for, so that a task's share does not grow with the table.

    bound: a number that the rows do not exceed. Where there is none, or the session's number of tasks is enough, df stays as it is.
    """
    session, asked = tasks(df.sparkSession, None), tasks(df.sparkSession, bound)
    return df.repartition(asked, *keys) if asked > session else df
