"""Joins that stay balanced when one key holds a large share of the rows.

A key is *hot* when it has more rows than ``threshold(total)``.  There can be
at most ``MAX_HOT_KEYS`` of them whatever the data, because each one holds more
than ``total / MAX_HOT_KEYS`` rows; that is the size bound that makes it safe to
broadcast the rows that belong to hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MIN_HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000


def threshold(total: int, min_rows: int | None = None) -> int:
    """Rows above which a key is hot, for ``total`` rows in all."""
    floor = MIN_HOT_ROWS if min_rows is None else min_rows
    return max(floor, -(-total // MAX_HOT_KEYS))


def lookup(
    rows: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` that has one row per key.

    ``hot`` is a one-column frame ``hot_id`` of the hot keys of ``rows``, or
    None when there are none.  Rows of hot keys stay where they are and meet a
    broadcast of the few table rows they need; the others are shuffled.
    """
    on = F.col(key) == F.col(table_key)
    if hot is None:
        return rows.join(table, on)
    keys = F.broadcast(hot)
    hot_table = table.join(keys, F.col(table_key) == F.col("hot_id"), "left_semi")
    cold_rows = rows.join(keys, F.col(key) == F.col("hot_id"), "left_anti")
    return cold_rows.join(table, on).unionByName(
        rows.join(F.broadcast(hot_table), on)
    )
