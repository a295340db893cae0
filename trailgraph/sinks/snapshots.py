"""Snapshot files: the vertices of a captured graph in a chosen format."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

# Format names with whether they take a compression flag, their
# file extension, and the Spark source that writes them.
FORMATS = {
    "TextFile": (True, "txt", "text"),
    "ObjectFile": (False, "obj", "parquet"),
    "ParquetFile": (False, "parquet", "parquet"),
    "AvroFile": (False, "avro", "avro"),
    "ORCFile": (False, "orc", "orc"),
    "CSVFile": (True, "csv", "csv"),
    "JSONFormat": (True, "json", "json"),
}


@dataclass(frozen=True)
class StorageFormat:
    name: str
    compressed: bool = False

    @staticmethod
    def parse(value: StorageFormat | str) -> StorageFormat:
        """From a string such as ``CSVFile(true)``."""
        if isinstance(value, StorageFormat):
            return value
        match = re.fullmatch(r"(\w+)\((true|false|)\)", value)
        if match is None or match[1] not in FORMATS:
            raise ValueError(f"unrecognized storage format {value!r}")
        name, flag = match.groups()
        if flag and not FORMATS[name][0]:
            raise ValueError(f"unrecognized storage format {value!r}")
        return StorageFormat(name, flag == "true")

    @property
    def extension(self) -> str:
        return FORMATS[self.name][1]

    @property
    def source(self) -> str:
        return FORMATS[self.name][2]

    @property
    def options(self) -> dict[str, str]:
        """Writer options.  An object file is an uncompressed binary table; the
        flag of the text formats means gzip."""
        if self.name == "ObjectFile":
            return {"compression": "none"}
        if FORMATS[self.name][0]:
            return {"compression": "gzip" if self.compressed else "none"}
        return {}


def write_snapshot(vertices: DataFrame, path: str, storage_format: StorageFormat) -> None:
    """Write ``(id, value)`` of the vertices; binary formats keep the type.

    Avro needs the spark-avro package; without it Spark says so.
    """
    value = F.col("attr") if "attr" in vertices.columns else F.lit(None).cast("string")
    rows = vertices.select("id", value.alias("value"))
    if storage_format.source == "text":
        rows = rows.select(
            F.format_string("(%s,%s)", F.col("id"), F.col("value").cast("string")).alias("line")
        )
    rows.write.format(storage_format.source).options(**storage_format.options).save(path)


#: Folders of stored edges and of commit markers, beside those of the vertices.
EDGES = "_edges"
COMMITS = "_commits"


def write_edges(edges: DataFrame, path: str, storage_format: StorageFormat) -> None:
    """Write ``(src, dst, value)`` of the edges of a snapshot."""
    value = F.col("attr") if "attr" in edges.columns else F.lit(None).cast("string")
    rows = edges.select("src", "dst", value.alias("value"))
    if storage_format.source == "text":
        text = F.col("value").cast("string")
        rows = rows.select(F.concat_ws(" ", F.col("src"), F.col("dst"), text).alias("line"))
    rows.write.format(storage_format.source).options(**storage_format.options).save(path)


def read_edges_of(
    spark: SparkSession, paths: list[str], base: str, storage_format: StorageFormat, value_type: str
) -> DataFrame:
    """Stored edges under ``base`` as ``(run_id, node_id, src, dst, value)``."""
    partitions = "run_id string, node_id bigint"
    if storage_format.source == "text":
        token = F.split("line", " ", 3)
        return (
            spark.read.schema(f"line string, {partitions}").option("basePath", base).text(paths)
            .select("run_id", "node_id", token[0].cast("bigint").alias("src"), token[1].cast("bigint").alias("dst"),
                    F.try_element_at(token, F.lit(3)).cast(value_type).alias("value"))
        )
    return (
        spark.read.schema(f"src bigint, dst bigint, value {value_type}, {partitions}")
        .option("basePath", base).format(storage_format.source).load(paths)
        .select("run_id", "node_id", "src", "dst", "value")
    )


def read_snapshots_of(
    spark: SparkSession,
    paths: list[str],
    base: str,
    storage_format: StorageFormat,
    value_type: str,
) -> DataFrame:
    """Snapshots under ``base`` as ``(run_id, node_id, id, value)``."""
    partitions = "run_id string, node_id bigint"
    if storage_format.source == "text":
        lines = (
            spark.read.schema(f"line string, {partitions}")
            .option("basePath", base)
            .text(paths)
        )
        pattern = r"^\((-?\d+),(.*)\)$"
        return lines.select(
            "run_id",
            "node_id",
            F.regexp_extract("line", pattern, 1).cast("bigint").alias("id"),
            F.regexp_extract("line", pattern, 2).cast(value_type).alias("value"),
        )
    return (
        spark.read.schema(f"id bigint, value {value_type}, {partitions}")
        .option("basePath", base)
        .format(storage_format.source)
        .load(paths)
        .select("run_id", "node_id", "id", "value")
    )


def snapshot_sizes(spark: SparkSession, locations: dict[int, str]) -> DataFrame:
    """``(node_id, size, location)``: bytes under each stored location.

    A node without a location has size 0 and ``<not stored>``.
    """
    nodes = spark.createDataFrame(
        [(node, path or None) for node, path in sorted(locations.items())],
        "node_id bigint, location string",
    )
    stored = sorted({path for path in locations.values() if path})
    if not stored:
        return nodes.select(
            "node_id", F.lit(0).cast("bigint").alias("size"), F.lit("<not stored>").alias("location")
        )
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(stored)
        .select(F.regexp_extract("path", r"node_id=(\d+)", 1).cast("bigint").alias("node_id"), "length")
    )
    sizes = files.groupBy("node_id").agg(F.sum("length").alias("size"))
    return nodes.join(sizes, "node_id", "left").select(
        "node_id",
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.coalesce("location", F.lit("<not stored>")).alias("location"),
    )
