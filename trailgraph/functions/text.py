"""Column functions for names, lists, sizes and durations.

All of them are built from Spark's own functions and stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Units of a file size, each 1024 times the one before.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB"]

# Algorithm aliases in descriptors and their names in run logs.
ALGORITHM_NAMES = {
    "bfs": "BFS",
    "pr": "PageRank",
    "pagerank": "PageRank",
    "wcc": "WCC",
    "sssp": "SSSP",
    "lcc": "LCC",
    "cdlp": "CDLP",
}

# Formats whose files are compressed without being told to.
COMPRESSED_FORMATS = ["parquet", "orc", "avro"]


def _column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def name_list(column: Column | str) -> Column:
    """A comma list as an array, trimmed, without blanks and ``#`` comments."""
    items = F.transform(F.split(_column(column), ","), lambda item: F.trim(item))
    return F.filter(items, lambda item: (item != "") & ~item.startswith("#"))


def algorithm_name(column: Column | str) -> Column:
    """The run-log name of an algorithm alias; NULL for an unknown one."""
    alias = F.lower(F.trim(_column(column)))
    names = F.create_map(*[F.lit(part) for pair in ALGORITHM_NAMES.items() for part in pair])
    return names[alias]


def human_size(column: Column | str) -> Column:
    """Bytes as a whole number and its unit, such as ``12 MB``."""
    size = _column(column).cast("double")
    step = F.lit(0)
    for power in range(1, len(SIZE_UNITS)):
        step = step + F.when(size >= float(1024**power), 1).otherwise(0)
    units = F.array(*[F.lit(unit) for unit in SIZE_UNITS])
    whole = F.floor(size / F.pow(F.lit(1024.0), step))
    return F.concat_ws(" ", whole.cast("string"), F.element_at(units, step + 1))


def human_duration(column: Column | str) -> Column:
    """Nanoseconds as days, hours, minutes and seconds; zero parts are left out."""
    nanos = _column(column)
    seconds = ((nanos - nanos % 1_000_000_000) / 1_000_000_000).cast("bigint")
    parts = {
        "day": F.floor(seconds / 86400),
        "hour": F.floor(seconds / 3600) % 24,
        "minute": F.floor(seconds / 60) % 60,
        "second": seconds % 60,
    }
    texts = [
        F.when(count == 1, F.lit(f"1 {unit}")).when(
            count > 1, F.concat(count.cast("string"), F.lit(f" {unit}s"))
        )
        for unit, count in parts.items()
    ]
    return F.concat_ws(" ", *texts)


def clock(column: Column | str) -> Column:
    """Seconds as ``mm:ss``, or ``h m s`` from an hour on."""
    seconds = F.floor(_column(column)).cast("bigint")
    hours = F.floor(seconds / 3600)
    minutes = F.floor(seconds / 60) % 60
    return F.when(
        hours > 0, F.format_string("%dh %dm %ds", hours, minutes, seconds % 60)
    ).otherwise(F.format_string("%02d:%02d", minutes, seconds % 60))


def two_decimals(column: Column | str) -> Column:
    number = _column(column)
    return F.when(number.isNotNull(), F.format_string("%.2f", number))


def escaped(column: Column | str) -> Column:
    """Underscores escaped for a typeset table."""
    return F.replace(_column(column), F.lit("_"), F.lit("\\_"))


def is_compressed(column: Column | str) -> Column:
    """Whether a storage-format string means compressed files."""
    text = _column(column)
    return text.contains("(true)") | F.lower(_base_format(text)).isin(COMPRESSED_FORMATS)


def _base_format(text: Column) -> Column:
    return F.regexp_replace(text, r"File|Format|\((true|false)?\)", "")


def format_label(column: Column | str) -> Column:
    """A storage-format string as a short label, ``-C`` when compressed."""
    text = _column(column)
    suffix = F.when(is_compressed(text), "-C").otherwise("")
    return F.concat(_base_format(text), suffix)
