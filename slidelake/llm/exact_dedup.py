"""Exact deduplication by Grace hashing, comparing complete content."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.shared import kept_rows, partitions, open_folder, run_folder, stored

_ARROW = pa.schema([("digest", pa.binary()), ("content", pa.string()), ("first_id", pa.int64()), ("n", pa.int64())])
SCHEMA = "digest binary, content string, first_id long, n long"
_NONE = 2**63 - 1
_RECORD = struct.Struct("<32sqqI")
Record = tuple[bytes, bytes, int, int]  # digest, content, smallest id, rows


def normalised(text: str = "text") -> F.Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


class Table:
    """Open addressing with linear probing; a slot matches only if its whole content is equal."""

    def __init__(self, budget: int):
        self.budget, self.used = budget, 0
        self.slots: list[int] = [-1] * 1024
        self.records: list[list] = []

    def _slot(self, digest: bytes, content: bytes) -> int:
        last = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & last
        while (i := self.slots[at]) >= 0 and self.records[i][1] != content:
            at = (at + 1) & last
        return at

    def add(self, digest: bytes, content: bytes, first: int, n: int) -> bool:
        """Counts a record in; False if its content is new and the budget is used up."""
        at = self._slot(digest, content)
        if (i := self.slots[at]) >= 0:
            found = self.records[i]
            found[2], found[3] = min(found[2], first), found[3] + n
            return True
        if self.records and self.used + len(content) > self.budget:
            return False
        self.slots[at] = len(self.records)
        self.records.append([digest, content, first, n])
        self.used += len(content) + 200
        if 2 * len(self.records) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for k, (d, c, _, _) in enumerate(self.records):
                self.slots[self._slot(d, c)] = k
        return True


class Spill:
    """Files of records in a folder shared by the cluster, removed once they are read."""

    def __init__(self, uri: str, fan_out: int, level: int):
        self.system, base = open_folder(uri)
        self.names = [f"{base}/{uuid.uuid4().hex}" for _ in range(fan_out)]
        self.level, self.open = level, {}

    def put(self, record: Record) -> None:
        digest, content, first, n = record
        k = hashlib.blake2b(digest, digest_size=8, salt=self.level.to_bytes(16, "little")).digest()
        k = int.from_bytes(k, "little") % len(self.names)
        if k not in self.open:
            self.open[k] = self.system.open_output_stream(self.names[k], buffer_size=1 << 18)
        self.open[k].write(_RECORD.pack(digest, first, n, len(content)) + content)

    def parts(self) -> Iterator[Iterator[Record]]:
        for out in self.open.values():
            out.close()
        for k in self.open:
            with self.system.open_input_stream(self.names[k], buffer_size=1 << 18) as stream:
                yield self._read(stream)
            self.system.delete_file(self.names[k])

    @staticmethod
    def _read(stream) -> Iterator[Record]:
        while head := stream.read(_RECORD.size):
            digest, first, n, size = _RECORD.unpack(head)
            yield digest, stream.read(size), first, n


def grace(records: Iterable[Record], folder: str, budget: int, fan_out: int = 16, level: int = 0) -> Iterator[Record]:
    """Distinct contents with their smallest id and number of rows.

    Content that doesn't fit the table's budget any more is partitioned to spill files by a
    hash that differs from level to level, and each file is treated alike. Copies of content
    that is in the table never spill, so a hot group can't recur.
    """
    table, spill = Table(budget), None
    for record in records:
        if not table.add(*record):
            spill = spill or Spill(folder, fan_out, level)
            spill.put(record)
    yield from map(tuple, table.records)
    del table
    if spill:
        for part in spill.parts():
            yield from grace(part, folder, budget, fan_out, level + 1)


def distinct_contents(hashed: DataFrame, budget: int = 64 << 20, fan_out: int = 16) -> DataFrame:
    """(digest, first_id, n) of each distinct content of (digest, content, first_id).

    Each scan task first collapses the copies it meets, so a content reaches the shuffle once a
    task at most; the shuffle by digest is the first partitioning, recursion goes on in tasks.
    """
    folder = run_folder(hashed.sparkSession, "grace")

    def batches_of(found: Iterable[Record], with_content: bool) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            digest, content, first, n = zip(*rows)
            text = [c.decode() for c in content] if with_content else [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((digest, text, first, n), _ARROW)], schema=_ARROW)

        for row in found:
            rows.append(row)
            size += len(row[1])
            if size > 4 << 20 or len(rows) == 10_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in batches:
            for digest, content, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                yield digest, content.encode(), _NONE if first is None else first, n

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[Record]:
            table = Table(budget)
            for record in records_of(batches):
                if not table.add(*record):  # full: hand the contents on and start again
                    yield from map(tuple, table.records)
                    table = Table(budget)
                    table.add(*record)
            yield from map(tuple, table.records)

        yield from batches_of(found(), True)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(grace(records_of(batches), folder, budget, fan_out), False)

    met = hashed.selectExpr("digest", "content", "first_id", "1L n").mapInArrow(collapse, SCHEMA)
    n = partitions(hashed)
    dealt = met.repartition(n, "digest") if n else met.repartition("digest")
    return dealt.mapInArrow(reduce, SCHEMA).drop("content")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after normalisation; null counts as empty, so nulls and empty
    texts are one group. Of a group the row with the smallest id stays; rows that repeat that
    id are all marked kept. A null id never beats another; in a group of nulls alone keep_id
    is null and all rows are kept. Other columns are ignored; an empty table gives no rows.
    """
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id"), normalised(text_column).alias("content"))
    hashed = ids.select("doc_id", "content", F.unhex(F.sha2("content", 256)).alias("digest"))
    groups = distinct_contents(hashed.selectExpr("digest", "content", "doc_id first_id"))
    repeated = stored(groups.where("n > 1"), "groups")
    rows = hashed.select("doc_id", "digest").join(repeated, "digest", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.expr(f"nullif(first_id, {_NONE}L)"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, whole: one of each group of equal texts, that with the smallest id.

    Rows that repeat an id are each judged by their own text. Of equal texts with equal ids one
    row stays. A null id stays only where no row of the group has an id. Other columns are kept
    as they are, whatever their names; very long texts are compared whole; no rows give no rows.
    """
    groups = exact_groups(docs, id_column, text_column).where("group_size > 1")
    decided = stored(groups.select("doc_id", F.col("text_sha256").alias("key"), F.col("kept").alias("stays")), "decided")
    return kept_rows(docs, decided, id_column, F.sha2(normalised(text_column), 256))
