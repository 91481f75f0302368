"""Token ids as length-delimited binary records, with a separate offset index."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidelake.llm.shared import one_per_task, open_folder, partitions, run_folder
from slidelake.llm.tokens import encoder, vocabulary

#: Body of a record: bytes per id (2 or 4), whether the document has an id, the id; ids follow.
HEAD = struct.Struct("<BBq")
LENGTH, CHECK = struct.Struct("<Q"), struct.Struct("<I")
#: Bytes of a data file, after which a task begins another.
ROLL = 256 << 20
#: Bytes of a record besides its body.
FRAME = LENGTH.size + 2 * CHECK.size
MANIFEST = "part long, turn long, data string, offsets string, n_records long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    """A CRC-32, rotated and shifted, so that a checksum of stored checksums stays meaningful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(body: bytes) -> bytes:
    """length, its masked checksum, body, its masked checksum."""
    length = LENGTH.pack(len(body))
    return b"".join((length, CHECK.pack(masked(length)), body, CHECK.pack(masked(body))))


def unframed(stream) -> bytes:
    """The next body of a stream; both checksums must hold."""
    head = stream.read(LENGTH.size + CHECK.size)
    (size,), (check,) = LENGTH.unpack(head[: LENGTH.size]), CHECK.unpack(head[LENGTH.size :])
    if check != masked(head[: LENGTH.size]):
        raise ValueError("length of a record is damaged")
    body = stream.read(size)
    (check,) = CHECK.unpack(stream.read(CHECK.size))
    if len(body) != size or check != masked(body):
        raise ValueError("a record is damaged")
    return body


def write_records(docs: DataFrame, folder: str, end_id: int = 2, vocab: str | None = None, roll: int = ROLL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes whole texts, writes them in ascending order of id, and returns the manifest.

    Rows are dealt out by ranges of the id, more of them where Spark takes the table to be
    large; each task writes data files of about `roll` bytes, and a file of offsets (8 bytes a
    record) for each, under names of their own. The manifest, written by Spark, lists the files
    of the attempts that succeeded; other files are never read. Ids take two bytes if the
    vocabulary allows. Null text counts as empty (the end id alone), a null id comes first,
    equal ids are ordered by a hash of the text and then by the text, so that ranges cut them
    too. A text of any length is one record; other columns are ignored; an empty table gives no
    files.
    """
    path = vocab or vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(f"{folder}/files")
        part, turn, data, offsets, n_ids = TaskContext.get().partitionId(), 0, None, [0], 0
        end = np.array([end_id], dtype="<u4").tobytes()

        def ended() -> pa.RecordBatch:
            data.close()
            with system.open_output_stream(f"{name}.offsets") as out:
                out.write(np.array(offsets, dtype="<u8").tobytes())
            return pa.RecordBatch.from_pydict({"part": [part], "turn": [turn], "data": [f"{name}.records"], "offsets": [f"{name}.offsets"], "n_records": [len(offsets) - 1], "n_ids": [n_ids]})

        for batch in batches:
            coder = encoder(path)
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(x.as_py() for x in batch.column(1))):
                if data is not None and offsets[-1] >= roll:
                    yield ended()
                    turn, data, offsets, n_ids = turn + 1, None, [0], 0
                if data is None:
                    name = f"{base}/{part:06d}-{turn:06d}-{uuid.uuid4().hex}"
                    data = system.open_output_stream(f"{name}.records", buffer_size=1 << 20)
                ids = np.frombuffer(ids + end, dtype="<u4")
                record = framed(body_of(doc_id, ids if coder.wide or end_id >> 16 else ids.astype("<u2")))
                data.write(record)
                offsets.append(offsets[-1] + len(record))
                n_ids += len(ids)
        if data is not None:
            yield ended()

    rows = docs.selectExpr(f"cast({id_column} as long) doc_id", f"{text_column} text", f"xxhash64({text_column}) tie")
    n = partitions(docs)
    ranges = rows.repartitionByRange(n, "doc_id", "tie") if n else rows.repartitionByRange("doc_id", "tie")
    ranges.sortWithinPartitions("doc_id", "tie", "text").drop("tie").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_at(system, data: str, offsets: str, i: int) -> tuple[int | None, np.ndarray]:
    """Record i of a data file, found through its offset file; for reads in any order."""
    with system.open_input_file(offsets) as index:
        index.seek(8 * i)
        (at,) = LENGTH.unpack(index.read(8))
    with system.open_input_file(data) as stream:
        stream.seek(at)
        return parsed(unframed(stream))


def body_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A record's body."""
    return HEAD.pack(ids.itemsize, doc_id is not None, doc_id or 0) + ids.tobytes()


def parsed(body: bytes) -> tuple[int | None, np.ndarray]:
    """Document id and token ids of a record's body."""
    width, known, doc_id = HEAD.unpack_from(body)
    return doc_id if known else None, np.frombuffer(body, dtype=f"<u{width}", offset=HEAD.size).astype("<u4")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record, from the files: document, ids before it, its ids' number and CRC-32."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = one_per_task(manifest.withColumn("before", before), manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(f"{folder}/files")
        for batch in batches:
            for file in batch.to_pylist():
                with system.open_input_file(file["offsets"]) as index:
                    offsets = np.frombuffer(index.read(), dtype="<u8")
                start, at, rows = file["before"], 0, []
                with system.open_input_stream(file["data"], buffer_size=1 << 20) as stream:
                    for i in range(file["n_records"]):
                        if at != offsets[i]:
                            raise ValueError(f"offset {i} of {file['data']} is wrong")
                        body = unframed(stream)
                        at += len(body) + FRAME
                        doc_id, ids = parsed(body)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000 or i + 1 == file["n_records"]:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []

    return files.mapInArrow(read, ROWS)


def token_records(docs: DataFrame, end_id: int = 2, vocab: str | None = None) -> DataFrame:
    """Writes the documents' ids to a new folder of the shared root and reads the files back."""
    folder = run_folder(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, end_id, vocab), folder)
