"""Algorithm results and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def save_result(vertices: DataFrame, path: str, value: str = "attr", ordered: bool = False) -> None:
    """Vertex values as text, one ``id value`` per line.

    With ``ordered``, the lines rise by id within each file and from file to
    file, in the order of their names: ids are dealt out by ranges, so each task
    sorts and writes one range.
    """
    rows = vertices.orderBy("id") if ordered else vertices
    rows.select(
        F.concat_ws(" ", F.col("id").cast("string"), F.col(value).cast("string"))
    ).write.text(path)


def result_places(spark: SparkSession, path: str) -> DataFrame:
    """``(file, place, line)``: the lines of a result with their place, from 1, in
    the whole of its files in the order of their names.

    A file may be read in blocks; each counts its own lines, and a window over
    the blocks alone says how many stand before each.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("number"),
        F.col("value").alias("line"),
    )
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        "file", "block", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("file", "block").orderBy("number")
    return (
        lines.withColumn("nth", F.row_number().over(within))
        .join(before, ["file", "block"])
        .select("file", (F.col("before") + F.col("nth")).alias("place"), "line")
    )


def misplaced(spark: SparkSession, path: str) -> DataFrame:
    """``(file, reason)`` of the files of an ordered result that break the order:
    ids fall within a file, or a file starts before the one in front of it ends.

    Neighbours are compared within blocks, and ends of blocks with the next; no
    task sees more than a block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("number"),
        F.split("value", " ")[0].cast("bigint").alias("id"),
    )
    within = Window.partitionBy("file", "block").orderBy("number")
    falls = F.col("id") < F.lag("id").over(within)
    blocks = lines.withColumn("falls", falls).groupBy("file", "block").agg(
        F.coalesce(F.bool_or("falls"), F.lit(False)).alias("falls"), F.min("id").alias("low"), F.max("id").alias("high")
    )
    previous = F.lag("high").over(Window.orderBy("file", "block"))
    reason = F.when(F.col("falls"), "falls").when(F.col("low") < F.col("previous"), "overlaps")
    return (
        blocks.withColumn("previous", previous)
        .select("file", reason.alias("reason")).filter("reason IS NOT NULL").distinct()
    )


def save_report(report: DataFrame, path: str) -> None:
    """A report table as CSV with a header."""
    report.write.option("header", True).csv(path)
