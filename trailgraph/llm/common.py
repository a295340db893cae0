"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import posixpath
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trailgraph.workspace import Workspace

#: Bytes of text that one step of a task works on; a longer text is a step of its own.
SLICE_BYTES = 4 << 20

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors import this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    import tempfile

    archive = os.path.join(tempfile.mkdtemp(prefix="trailgraph-code-"), "trailgraph.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)


def workspace(spark: SparkSession, label: str) -> Workspace:
    ship(spark)
    return Workspace(spark, label)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name."""
    taken = {name.lower() for name in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(batch: pa.RecordBatch, text: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with about ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(text), 0).to_pylist()
    first = size = 0
    for row, length in enumerate(lengths):
        if row > first and size + length > most:
            yield batch.slice(first, row - first)
            first, size = row, 0
        size += length
    yield batch.slice(first)


def by_size(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``most`` characters in all."""
    first = size = 0
    for number, text in enumerate(texts):
        length = len(text or "")
        if number > first and size + length > most:
            yield texts[first:number]
            first, size = number, 0
        size += length
    if first < len(texts):
        yield texts[first:]


def add_struct(
    docs: DataFrame,
    text: str,
    name: str,
    kind: str,
    make: Callable[[], Callable[[pa.Array], pa.Array]],
) -> DataFrame:
    """``docs`` with a column ``name`` that a function computes from slices of texts.

    ``make`` runs once per task and returns the function, which gets the texts
    of a slice and returns as many structs.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for part in slices(batch, batch.column(place)):
                found = compute(part.column(place))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, found], names=[*part.schema.names, name]
                )

    return docs.mapInArrow(run, schema)


def text_only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that no other column can clash with a result."""
    return docs.select(*[F.col(f"`{name}`") for name in names])


def crc32_remainder(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def file_system(uri: str):
    """The file system and the path for a folder that Spark names as ``uri``."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def join_path(*parts: str) -> str:
    return posixpath.join(*parts)


def partitions_for(docs: DataFrame, each: int = 1) -> int:
    """Partitions of the scan below ``docs``, from the plan alone."""
    return max(1, docs.rdd.getNumPartitions() // each)
