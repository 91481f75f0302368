"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from slidelake.llm.shared import stored
from slidelake.llm.tokens import encoder, vocabulary

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")]])


class OpenBins:
    """A fixed number of open bins; a bitset says which amounts of free space they have.

    A piece goes to the open bin with the least free space that holds it (best fit). Without
    one, a bin is opened; were that one too many, the fullest closes first.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f: an open bin has f tokens free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_made = 0

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of 1 to capacity tokens."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = self._take(space)
        else:
            space, chosen = self.capacity, self.n_made
            self.n_made += 1
        left = space - length
        if left:
            if self.n_open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            self.bins[left].append(chosen)
            self.free |= 1 << left
            self.n_open += 1
        return chosen, self.capacity - space


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first that may be shorter."""
    first = length % capacity
    cuts = [(0, first)] if first else []
    return cuts + [(s, capacity) for s in range(first, length, capacity)]


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, open_bins: int = 4096, look_ahead: int = 65_536, regroup: int = 500_000, vocab: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: its document, place in the document, checksum, sequence and offset.

    Bounded-space online best fit within each input partition, without a shuffle; the state of
    a task is `open_bins` bins and the pieces of at most `look_ahead`, which are placed longest
    first. Sequences that are still open when a task ends are taken apart, and their pieces
    (without ids or texts) are brought together, about `regroup` to a task, and packed again
    the same way; so the number of sequences hardly depends on how the input is split.

    Only a document of over `capacity` tokens is cut. Every row is a document of its own, also
    when ids or texts repeat. Null text counts as empty: one piece with the end id alone. A
    null id stays null. Pieces of equal length are placed in the order of the rows. Texts of any
    length are encoded whole. Other columns are ignored; an empty table gives no rows.
    """
    path = vocab or vocabulary()

    def placer(waiting: list, bins: OpenBins, first_sequence: int):
        def placed() -> list[tuple]:
            waiting.sort(key=lambda p: -p[3])
            rows = []
            for doc_id, piece, start, length, crc in waiting:
                sequence, offset = bins.place(length)
                rows.append((doc_id, piece, start, length, crc, first_sequence + sequence, offset))
            waiting.clear()
            return rows

        return placed

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        bins, waiting = OpenBins(capacity, open_bins), []
        number = TaskContext.get().partitionId() << 33
        placed, held = placer(waiting, bins, number), []

        def told() -> Iterator[pa.RecordBatch]:
            # rows of sequences that are open are held until these close; what is left at the end is open
            nonlocal held
            held += placed()
            still = {number + b for free in bins.bins for b in free}
            if closed := [r for r in held if r[5] not in still]:
                yield batch(closed)
            held = [r for r in held if r[5] in still]

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder(path).encode(x.as_py() for x in b.column(1))):
                ids += end
                for i, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    waiting.append((doc_id, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                if len(waiting) >= look_ahead:
                    yield from told()
        yield from told()
        if held:
            yield batch([(*r[:5], None, None) for r in held])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, waiting = OpenBins(capacity, open_bins), []
        placed = placer(waiting, bins, 1 << 62 | TaskContext.get().partitionId() << 33)
        for b in batches:
            waiting += zip(*(c.to_pylist() for c in b.columns[:5]))
            if len(waiting) >= look_ahead:
                yield batch(placed())
        if waiting:
            yield batch(placed())

    rows = stored(docs.selectExpr(f"cast({id_column} as long) doc_id", f"{text_column} text").mapInArrow(first, SCHEMA), "pieces")
    left = rows.where("sequence_id is null")
    tasks = -(-left.count() // regroup)
    closed = rows.where("sequence_id is not null")
    return closed.union(left.repartition(tasks).mapInArrow(again, SCHEMA)) if tasks else closed
