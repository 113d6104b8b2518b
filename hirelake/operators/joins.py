"""Join hints: sides whose size is bounded, and sides that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def one_row(df: DataFrame) -> DataFrame:
    """Mark an ungrouped aggregate as broadcastable: it has exactly one row."""
    return F.broadcast(df)


def many_rows(df: DataFrame) -> DataFrame:
    """Mark a side that grows with the input, so that its join is dealt by key.

    Before a table is read its size is a guess (files as compressed, 20 bytes a text, also
    for a checkpoint of it), by which hundreds of MB would be collected for a broadcast.
    """
    return df.hint("merge")
