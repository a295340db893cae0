"""Token ids in binary files of fixed width, and reading them back.

A file has blocks of ids, each id in the fewest bits that hold the vocabulary,
then an index (the place of every block, the id and first token of every
document), then a fixed tail that says where the index is.  A block unpacks
with numpy at once; any range of tokens reads only the blocks it touches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from trailgraph.llm.common import file_system, join_path, slices, text_only, workspace
from trailgraph.llm.token_cache import encoder

BLOCK = 65_536
_MAGIC = b"TRAILTOK"
_TAIL = struct.Struct("<8sIIQQQQ")  # magic, bits, block, tokens, documents, blocks, index place
_NO_ID = -(1 << 63)
_MANIFEST = "part int, path string, first_doc bigint, n_docs bigint, n_tokens bigint, bytes bigint"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, ``bits`` each, lowest bit first."""
    if bits in (8, 16, 32):  # the same layout, without single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(each.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits)
    weights = np.left_shift(np.uint32(1), np.arange(bits, dtype=np.uint32))
    return (each.reshape(count, bits).astype("<u4") * weights).sum(axis=1, dtype="<u4")


class TokenWriter:
    """Writes one file, block by block."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.pending: list[np.ndarray] = []
        self.waiting = self.tokens = self.written = 0
        self.blocks: list[int] = []
        self.docs: list[int] = []
        self.starts: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(_NO_ID if doc is None else doc)
        self.starts.append(self.tokens)
        self.pending.append(ids)
        self.tokens += len(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * self.block:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        whole = len(ids) if rest else len(ids) // self.block * self.block
        for at in range(0, whole, self.block):
            data = pack(ids[at : min(at + self.block, whole)], self.bits)
            self.blocks.append(self.written)
            self.out.write(data)
            self.written += len(data)
        self.pending = [ids[whole:]]
        self.waiting = len(ids) - whole

    def close(self) -> int:
        self._flush(True)
        for values in (self.blocks, self.docs, self.starts):
            self.out.write(np.array(values, "<i8").tobytes())
        tail = _TAIL.pack(
            _MAGIC, self.bits, self.block, self.tokens, len(self.docs), len(self.blocks), self.written
        )
        self.out.write(tail)
        self.out.close()
        return self.written + 8 * (2 * len(self.docs) + len(self.blocks)) + len(tail)


class TokenReader:
    """Random access to one file; ``source`` is a seekable file with a size."""

    def __init__(self, source):
        self.source = source
        tail = self._at(source.size() - _TAIL.size, _TAIL.size)
        magic, self.bits, self.block, self.tokens, docs, blocks, self.index = _TAIL.unpack(tail)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        table = np.frombuffer(self._at(self.index, 8 * (2 * docs + blocks)), "<i8")
        self.blocks, self.docs, self.starts = np.split(table, [blocks, blocks + docs])

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to ``stop``, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        count = min(self.tokens, (last + 1) * self.block) - first * self.block
        end = self.blocks[last + 1] if last + 1 < len(self.blocks) else self.index
        begin = int(self.blocks[first])
        whole = (end - begin) if last == first else None
        if whole is not None or self.block * self.bits % 8 == 0:
            ids = unpack(self._at(begin, int(end) - begin), count, self.bits)
        else:  # blocks padded to bytes
            ids = np.concatenate([self.read(b * self.block, min(self.tokens, (b + 1) * self.block))
                                  for b in range(first, last + 1)])
        return ids[start - first * self.block : stop - first * self.block]

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc, first token, ids)`` in order, reading some blocks at a time."""
        ends = np.append(self.starts[1:], self.tokens)
        row = 0
        while row < len(self.docs):
            first = int(self.starts[row])
            stop = max(row + 1, int(np.searchsorted(ends, first + step, side="right")))
            ids = self.read(first, int(ends[stop - 1]))
            for r in range(row, stop):
                doc = int(self.docs[r])
                at = int(self.starts[r])
                yield None if doc == _NO_ID else doc, at, ids[at - first : int(ends[r]) - first]
            row = stop


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Write the ids of all texts below ``folder`` in ascending order of ``doc_id``.

    Returns one row per file: its part number in order, path, first document,
    documents, tokens and bytes.  A null or empty text is the end id alone; a
    null ``doc_id`` comes first; rows that share a ``doc_id`` are all kept, in
    order of their texts; an empty table gives no file.  The texts are shuffled
    once, by ranges of ``doc_id``.  A file is written under a name of its own
    attempt and renamed when whole, so a task that is run again replaces it.
    """
    space = workspace(docs.sparkSession, "token-files")
    bits_of = encoder(tokenizer).vocabulary
    bits = max(int(end_id), bits_of - 1, 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        tokens = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        part = context.partitionId()
        mine = join_path(path, f".part-{part:06d}-{context.taskAttemptId()}")
        writer = None
        for batch in batches:
            for rows in slices(batch, batch.column(1)):
                if writer is None:
                    files.create_dir(path, recursive=True)
                    writer = TokenWriter(files.open_output_stream(mine), bits, block)
                encoded = tokens.encode(rows.column(1).to_pylist())
                for doc, ids in zip(rows.column(0).to_pylist(), encoded):
                    writer.add(doc, np.frombuffer(ids + end, "<u4"))
        if writer is None:
            return
        size = writer.close()
        final = join_path(path, f"part-{part:06d}.tok")
        files.move(mine, final)
        first = writer.docs[0]
        row = {
            "part": part, "path": join_path(folder, f"part-{part:06d}.tok"),
            "first_doc": None if first == _NO_ID else first,
            "n_docs": len(writer.docs), "n_tokens": writer.tokens, "bytes": size,
        }
        yield pa.RecordBatch.from_pylist(
            [row],
            pa.schema({"part": pa.int32(), "path": pa.string(), "first_doc": pa.int64(),
                       "n_docs": pa.int64(), "n_tokens": pa.int64(), "bytes": pa.int64()}),
        )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc").sortWithinPartitions("doc", "text")
    return space.write("manifest", ordered.mapInArrow(run, _MANIFEST)).df


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, ids)`` of all documents of the files of ``manifest``.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian
    unsigned 32-bit.  The window below sees one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select(
        "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "ids": pa.binary()})
        for batch in batches:
            for row in batch.to_pylist():
                store, path = file_system(row["path"])
                with store.open_input_file(path) as source:
                    found, size = [], 0
                    for doc, at, ids in TokenReader(source).documents():
                        found.append({"doc_id": doc, "start": row["base"] + at, "ids": ids.tobytes()})
                        size += ids.nbytes
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, size = [], 0
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema)

    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "doc_id bigint, start bigint, ids binary")
