"""Token ids of a corpus in files of compressed planes.

Documents are encoded, each followed by an end id, and laid end to end in ascending
order of doc_id. The stream is cut into chunks of a fixed number of ids. A chunk is
transposed: its first plane holds the lowest byte (or bit) of every id, the next
plane the next one, and so on. Planes are alike within themselves, so each is
compressed on its own with zstandard; planes of high bytes are nearly nothing.

A file holds, one after the other: a magic word, the planes of its chunks, a table of
its documents (ids and lengths, as planes too), the chunk index (place, number of ids,
plane sizes and checksum of every chunk) and a footer of fixed size that says where
those begin. Files end between documents, at `file_ids` ids or the document that
passes them. A manifest beside the files has a row per file, with the place of its
first id in the whole stream; with it and the chunk index any span of ids is read from
the chunks it lies in.

* A null or empty text is the end id alone. Null ids come first; documents of one id
  follow each other by a hash of their texts, equal ones in any order. Repeated rows are
  documents of their own. An empty table gives no files and an empty result.
* Texts of any length are encoded whole, in order, in one task; neither id nor text
  hash gathers rows, as equal ones are cut apart too. Other columns are ignored.
* A file that does not match its checksums is refused by name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.common import cut_lineage, partitions, running
from assay.llm.encoding import encoder
from assay.llm.words import chunks

END_ID = 0
CHUNK_IDS = 1 << 16
FILE_IDS = 1 << 24
LEVEL = 3
#: Ids handed to Spark in one batch when files are read.
BATCH_IDS = 1 << 19

MAGIC = b"IDPLANE1"
#: Magic, planes by bit or byte, part, number within the part, documents, ids, where the
#: document table and the chunk index begin, checksum of both.
FOOTER = struct.Struct("<8sBqqqqqqI")
ENTRY = np.dtype([("at", "<i8"), ("n", "<i4"), ("crc", "<u4")])


# Planes


def planes(values: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of whole numbers, lowest first: of bytes, or of bits packed into bytes."""
    width = values.dtype.itemsize
    rows = values.astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(len(values), width).T
    if bits:
        cells = np.unpackbits(rows[:, :, None], axis=2, bitorder="little")
        rows = np.packbits(cells.transpose(0, 2, 1).reshape(8 * width, len(values)), axis=1)
    return [np.ascontiguousarray(r).tobytes() for r in rows]


def joined(found: list[bytes], n: int, dtype: np.dtype, bits: bool = False) -> np.ndarray:
    """What `planes` took apart: `n` numbers."""
    rows = np.stack([np.frombuffer(p, dtype=np.uint8) for p in found])
    if bits:
        cells = np.unpackbits(rows, axis=1)[:, :n].reshape(-1, 8, n)
        rows = np.packbits(cells.transpose(0, 2, 1), axis=2, bitorder="little")[:, :, 0]
    return np.ascontiguousarray(rows.T).reshape(-1).view(dtype)


def packed(values: np.ndarray, bits: bool = False) -> tuple[bytes, list[int]]:
    """Compressed planes end to end, and the size of each."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    parts = [squeeze.compress(p) for p in planes(values, bits)]
    return b"".join(parts), [len(p) for p in parts]


def unpacked(
    data: memoryview, sizes: list[int], n: int, dtype: np.dtype, bits: bool = False
) -> np.ndarray:
    loosen = zstandard.ZstdDecompressor()
    parts, at = [], 0
    for size in sizes:
        parts.append(loosen.decompress(data[at : at + size]))
        at += size
    return joined(parts, n, dtype, bits)


# Files


class PlaneFile:
    """The bytes of one file while it is written; chunks are compressed as they fill."""

    def __init__(self, part: int, number: int, chunk_ids: int, bits: bool):
        self.part, self.number, self.chunk_ids, self.bits = part, number, chunk_ids, bits
        self.parts, self.size = [MAGIC], len(MAGIC)
        self.entries, self.sizes = [], []
        self.doc_ids, self.lengths = [], []
        self.open: list[np.ndarray] = []
        self.waiting, self.ids = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.open.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= self.chunk_ids:
            held = np.concatenate(self.open)
            full = len(held) - len(held) % self.chunk_ids
            for first in range(0, full, self.chunk_ids):
                self._chunk(held[first : first + self.chunk_ids])
            self.open, self.waiting = [held[full:]], len(held) - full

    def _chunk(self, ids: np.ndarray) -> None:
        data, sizes = packed(ids, self.bits)
        self.entries.append((self.size, len(ids), zlib.crc32(data)))
        self.sizes.append(sizes)
        self.parts.append(data)
        self.size += len(data)

    def done(self) -> bytes:
        """The whole file."""
        if self.waiting:
            self._chunk(np.concatenate(self.open))
        known = np.array([d is not None for d in self.doc_ids])
        doc_ids = np.array([d or 0 for d in self.doc_ids], dtype=np.int64)
        tables = [
            _table(known.astype(np.uint8)),
            _table(doc_ids),
            _table(np.array(self.lengths, dtype=np.int64)),
        ]
        index = [
            _table(np.array(self.entries, dtype=ENTRY).view(np.uint8)),
            _table(np.array(self.sizes, dtype=np.int32).reshape(-1)),
        ]
        documents, index = b"".join(tables), b"".join(index)
        foot = FOOTER.pack(
            MAGIC,
            self.bits,
            self.part,
            self.number,
            len(self.doc_ids),
            self.ids,
            self.size,
            self.size + len(documents),
            zlib.crc32(documents + index),
        )
        return b"".join([*self.parts, documents, index, foot])


def _table(values: np.ndarray) -> bytes:
    data, sizes = packed(values)
    return struct.pack(f"<qi{len(sizes)}i", len(values), len(sizes), *sizes) + data


def _tables(data: memoryview, kinds: list[str]) -> list[np.ndarray]:
    found, at = [], 0
    for kind in kinds:
        n, many = struct.unpack_from("<qi", data, at)
        sizes = list(struct.unpack_from(f"<{many}i", data, at + 12))
        at += 12 + 4 * many
        found.append(unpacked(data[at:], sizes, n, np.dtype(kind)))
        at += sum(sizes)
    return found


class Opened:
    """A file read: its footer, documents and chunks. `data` ends with the sink's one byte more."""

    def __init__(self, path: str, data: bytes):
        self.path, self.data = path, memoryview(data)[:-1]
        if len(self.data) < len(MAGIC) + FOOTER.size or self.data[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a file of id planes: {path}")
        foot = len(self.data) - FOOTER.size
        magic, bits, self.part, self.number, self.docs, self.ids, at, index, crc = FOOTER.unpack(
            self.data[foot:]
        )
        if magic != MAGIC or zlib.crc32(self.data[at:foot]) != crc:
            raise ValueError(f"file of id planes with a damaged index: {path}")
        self.bits, self._at, self._index, self._foot = bool(bits), at, index, foot

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids and their numbers of ids."""
        known, ids, lengths = _tables(self.data[self._at : self._index], ["u1", "<i8", "<i8"])
        return [d if k else None for d, k in zip(ids.tolist(), known, strict=True)], lengths

    def chunks(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Chunks that hold ids `first` to before `last` of the file, each with its place."""
        raw, sizes = _tables(self.data[self._index : self._foot], ["u1", "<i4"])
        entries = raw.view(ENTRY)
        sizes = sizes.reshape(len(entries), -1)
        ends = np.cumsum(entries["n"].astype(np.int64))
        last = self.ids if last is None else last
        begin = int(np.searchsorted(ends, first, side="right"))
        for i in range(begin, len(entries)):
            start = int(ends[i] - entries["n"][i])
            if start >= last:
                return
            at, size = int(entries["at"][i]), int(sizes[i].sum())
            data = self.data[at : at + size]
            if zlib.crc32(data) != entries["crc"][i]:
                raise ValueError(f"file of id planes with a damaged chunk {i}: {self.path}")
            n = int(entries["n"][i])
            yield start, unpacked(data, sizes[i].tolist(), n, np.dtype("<u4"), self.bits)


# Writing


def write_ids(
    documents: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    end_id: int = END_ID,
    chunk_ids: int = CHUNK_IDS,
    file_ids: int = FILE_IDS,
    bits: bool = False,
) -> None:
    """Encode the documents and write their ids below `folder`, a place Spark can write to.

    `tokenizer` is a file that every executor has, like an installed package.
    """
    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumns({"said": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(
            partitions(documents.sparkSession), F.col("doc_id").asc_nulls_first(), "said", "row"
        )
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "said")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        file = PlaneFile(part, number, chunk_ids, bits)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last in chunks(texts):
                coded = encode(texts.slice(first, last - first))
                for doc_id, found in zip(ids.slice(first, last - first).to_pylist(), coded, strict=True):
                    file.add(doc_id, np.append(found, np.uint32(end_id)))
                    if file.ids >= file_ids:
                        yield one(file)
                        number += 1
                        file = PlaneFile(part, number, chunk_ids, bits)
        if file.ids:
            yield one(file)

    def one(file: PlaneFile) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file.done()], pa.binary())], ["value"])

    # A string column passes bytes through as they are; each row is a file of its own.
    files = ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(f"{folder}/files")
    spark = documents.sparkSession
    totals = _opened(spark, folder, lambda f: [(f.part, f.number, f.docs, f.ids)])
    sums = {"last": F.col("ids")}
    placed = running(totals, [], [F.col("part"), F.col("number")], sums)
    start = (F.col("last") - F.col("ids")).alias("start")
    placed.select("part", "number", "docs", "ids", start).write.parquet(f"{folder}/manifest")


# Reading


def _files(spark: SparkSession, folder: str) -> DataFrame:
    whole = spark.read.format("binaryFile").load(f"{folder}/files")
    return whole.where("length > 1").select("path", "content")


def _opened(spark: SparkSession, folder: str, told) -> DataFrame:
    """Rows (part, number, docs, ids) that `told` makes of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                rows += told(Opened(path.as_py(), data.as_py()))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "number", "docs", "ids"])

    schema = "part long, number long, docs long, ids long"
    return cut_lineage(_files(spark, folder).mapInArrow(run, schema))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, number, docs, ids, start: a row per file; `start` is the place of its first id."""
    return spark.read.parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids: a row per document, read back from the files.

    `start` counts the ids of all documents before; `ids` has them as little-endian
    unsigned 32-bit integers, the end id included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                yield from documents_of(Opened(path.as_py(), data.as_py()))

    schema = "part long, number long, doc_id long, at long, n_tokens long, ids binary"
    found = _files(spark, folder).mapInArrow(run, schema)
    starts = manifest(spark, folder).select("part", "number", "start")
    return found.join(starts, ["part", "number"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids"
    )


def documents_of(file: Opened) -> Iterator[pa.RecordBatch]:
    """Batches of a file's documents; what is decoded at a time is a batch or one document."""
    doc_ids, lengths = file.documents()
    ends = np.cumsum(lengths)
    done, place = 0, 0  # documents given out, ids taken out of `held`
    held: list[np.ndarray] = []
    waiting = 0
    for start, ids in file.chunks():
        held.append(ids)
        waiting += len(ids)
        full = int(np.searchsorted(ends, start + len(ids), side="right"))
        if full > done and (waiting >= BATCH_IDS or full == len(ends)):
            flat = np.concatenate(held)
            bounds = np.concatenate(([place], ends[done:full])) - place
            last = int(bounds[-1])
            whole = pa.py_buffer(np.ascontiguousarray(flat[:last]))
            offsets = pa.py_buffer((4 * bounds).astype(np.int32))
            n = full - done
            columns = [
                pa.array(np.full(n, file.part)),
                pa.array(np.full(n, file.number)),
                pa.array(doc_ids[done:full], pa.int64()),
                pa.array(bounds[:-1] + place),
                pa.array(lengths[done:full]),
                pa.Array.from_buffers(pa.binary(), n, [None, offsets, whole]),
            ]
            names = ["part", "number", "doc_id", "at", "n_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
            held, waiting = [flat[last:]], len(flat) - last
            done, place = full, place + last


def read_span(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """start, ids: the ids at places `first` to before `last` of the stream, by chunk.

    Only the files that the manifest names are decoded, and of those only the chunks that
    their index names.
    """
    inside = (F.col("start") < last) & (F.col("start") + F.col("ids") > first)
    wanted = manifest(spark, folder).where(inside).select("part", "number", "start").toLocalIterator()
    starts = {(r["part"], r["number"]): r["start"] for r in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                file = Opened(path.as_py(), data.as_py())
                begin = starts.get((file.part, file.number))
                if begin is None:
                    continue
                for at, ids in file.chunks(first - begin, last - begin):
                    low = max(first - begin - at, 0)
                    own = ids[low : last - begin - at]
                    columns = [pa.array([begin + at + low]), pa.array([own.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["start", "ids"])

    return _files(spark, folder).mapInArrow(run, "start long, ids binary")
