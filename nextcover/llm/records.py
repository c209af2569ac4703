"""Token ids in length-delimited binary files, with an offset index for reads in any order.

A file is a row of records: payload length (unsigned 64 bits, little endian), masked CRC-32 of
those eight bytes (32 bits), payload, masked CRC-32 of the payload. The mask turns the checksum
right by 15 bits and adds 0xA282EAD8, so that a checksum of data that hold checksums stays
sound. A payload is the document's id (64 bits), one byte that is 1 for a null id, one byte for
the width of an id (2 or 4), and the ids. Beside each file ``x.rec`` stands ``x.idx``, the
places of its records (unsigned 64 bits each).

Files have names of their own for every attempt of a task; only those in the manifest, a table
of the files of the attempts that ended well, belong to the data set.

Nulls: a null text is an empty one and gives the end id alone; rows with a null id come first,
repeated rows are kept and stand in the order of their texts. An empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nextcover.llm.common import shared_folder, slices, small_batches, stored, texts_of
from nextcover.llm.token_cache import encoder, ids_crc32

MASK = 0xA282EAD8
FILE_BYTES = 32 << 20
MANIFEST = "part int, file_no int, file string, records long, ids long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17 & 0xFFFFFFFF)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if ids.dtype.itemsize == 2 else 4
    payload = struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked_crc(head)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """Document id, ids and the next record's place; raises on a damaged record."""
    head = bytes(data[at:at + 8])
    if len(head) < 8 or masked_crc(head) != struct.unpack_from("<I", data, at + 8)[0]:
        raise ValueError(f"damaged length at byte {at}")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = bytes(data[at + 12:end])
    if end + 4 > len(data) or masked_crc(payload) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"damaged record at byte {at}")
    doc_id, none, width = struct.unpack_from("<qBB", payload)
    return None if none else doc_id, np.frombuffer(payload, f"<u{width}", offset=10), end + 4


class _File:
    def __init__(self, folder: str, part: int, number: int):
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        self.name = f"part-{part:05d}-{number:03d}-{uuid.uuid4().hex}"
        self.stream, self.where, self.path = where.open_output_stream(f"{path}/{self.name}.rec"), where, path
        self.part, self.number, self.places, self.size, self.ids = part, number, [], 0, 0

    def add(self, record: bytes, n: int) -> None:
        self.places.append(self.size)
        self.stream.write(record)
        self.size += len(record)
        self.ids += n

    def close(self) -> tuple:
        self.stream.close()
        with self.where.open_output_stream(f"{self.path}/{self.name}.idx") as index:
            index.write(np.array(self.places, "<u8").tobytes())
        return self.part, self.number, self.name, len(self.places), self.ids, self.size


def write_records(docs: DataFrame, folder: str, vocabulary: str, kind: str, end_id: int,
                  file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every whole text, put the end id behind it and write the records in ascending order
    of doc_id below ``folder``. Returns the manifest."""
    small_batches(docs.sparkSession)
    ordered = texts_of(docs).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number, file, done = encoder(vocabulary, kind), TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"]
            for lo, hi in slices(texts):
                for doc_id, tokens in zip(ids[lo:hi], enc.encode(texts.slice(lo, hi - lo).to_pylist())):
                    file = file or _File(folder, part, number)
                    file.add(frame(doc_id, np.append(tokens, tokens.dtype.type(end_id))), len(tokens) + 1)
                    if file.size >= file_bytes:
                        done.append(file.close())
                        file, number = None, number + 1
        if file:
            done.append(file.close())
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

    return stored(ordered.mapInArrow(write, MANIFEST))


def read_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Read all files back, checking every record: where each document starts among the ids of
    all, how many it has, and their checksum. One row per file decides a start, so the running
    sum is over files, not documents."""
    before = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = stored(manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_file(f"{path}/{row['file']}.rec") as f:
                    data = memoryview(f.read())
                at, start, out = 0, row["base"], []
                while at < len(data):
                    doc_id, ids, at = unframe(data, at)
                    out.append((doc_id, start, len(ids), ids_crc32(ids)))
                    start += len(ids)
                if len(out) != row["records"]:
                    raise ValueError(f"{row['file']}: {len(out)} of {row['records']} records")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [f.split()[0] for f in READ.split(", ")])

    return files.repartition(max(1, files.count())).mapInArrow(read, READ)


def read_shuffled(spark: SparkSession, folder: str, manifest: DataFrame, seed: int) -> DataFrame:
    """(doc_id, ids) of all records, dealt out at random by the seed: the index files tell where
    each record is, every task seeks its own."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["file"].to_pylist():
                with where.open_input_file(f"{path}/{name}.idx") as f:
                    at = np.frombuffer(f.read(), "<u8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at)], ["file", "place"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        open_files: dict = {}
        for batch in batches:
            ids, tokens = [], []
            for name, at in zip(batch["file"].to_pylist(), batch["place"].to_pylist()):
                if name not in open_files:
                    if len(open_files) >= 64:
                        open_files.popitem()[1].close()
                    open_files[name] = where.open_input_file(f"{path}/{name}.rec")
                f = open_files[name]
                head = f.read_at(12, at)
                whole = memoryview(f.read_at(struct.unpack_from("<Q", head)[0] + 16, at))
                doc_id, found, _ = unframe(whole, 0)
                ids.append(doc_id)
                tokens.append(found.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "ids"])

    files = manifest.select("file")
    index = files.repartition(max(1, files.count())).mapInArrow(places, "file string, place long")
    dealt = index.repartitionByRange(F.xxhash64(F.lit(seed), "file", "place")).sortWithinPartitions(F.xxhash64(F.lit(seed), "file", "place"))
    return dealt.mapInArrow(fetch, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_records(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", kind: str = "words", end_id: int = 2,
                  folder: str | None = None) -> DataFrame:
    """Write the table's token records and return what reading them back gives."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    return read_digests(spark, folder, write_records(docs, folder, vocabulary, kind, end_id))
