"""WARC archives of pages, and a globally ordered index of their captures."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidelake.llm.shared import one_per_task, open_folder, run_folder, small, stored

#: Bytes of an archive after which a task begins the next one; also bounds a run of the index.
ARCHIVE = 64 << 20
#: Time of the first capture; page n is captured n seconds later, modulo SPAN.
EPOCH, SPAN = datetime(2020, 1, 1, tzinfo=UTC), 1_000_000_000
ENTRY = "url_key string, captured_at string, page_id long, archive string, offset long, run string, at long"
MERGED = "url_key string, captured_at string, archive string, offset long, part int, place long"
RECORD = "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path: captures of a host, and of a URL, sort together."""
    bare = (url or "").partition("://")[2] or (url or "")
    host, slash, path = bare.partition("/")
    return ",".join(reversed(host.lower().split(":")[0].split("."))) + ")" + slash + path


def base32_sha1(data: bytes) -> str:
    """The usual payload digest of archives, without the algorithm's name."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or without its payload a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {captured(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def captured(page_id: int | None) -> str:
    """The capture time of a page: any 64-bit id gives one; without an id it is EPOCH."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % SPAN)).strftime("%Y-%m-%dT%H:%M:%SZ")


def read_head(stream) -> dict[str, str]:
    """The header lines of a record or HTTP block by lower-case name."""
    found = {"": stream.readline().decode().strip()}
    while line := stream.readline().decode().rstrip("\r\n"):
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def parsed(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record."""
    stream = io.BytesIO(data)
    head = read_head(stream)
    block = io.BytesIO(stream.read(int(head["content-length"])))
    http = read_head(block)
    payload, digest = block.read(), head["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"])
    if head["warc-type"] == "response" and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
    page_id, refers_to = (int(x) if (x := head.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None for name in ("warc-record-id", "warc-refers-to"))
    return page_id, size, digest, head["warc-type"], refers_to


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream; an archive has a member per record."""
    buffer, at = b"", 0
    while True:
        member, parts, used = zlib.decompressobj(31), [], 0
        while not member.eof:
            buffer = buffer or stream.read(1 << 17)
            if not buffer:
                if used:
                    raise ValueError("an archive ends within a record")
                return
            parts.append(member.decompress(buffer))
            used += len(buffer) - len(member.unused_data)
            buffer = member.unused_data
        yield at, b"".join(parts)
        at += used


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if building and other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._replay(w)


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per (page_id, url, html) row; gives the index entries, in sorted runs.

    Payloads of at least `least` bytes that are equal (by SHA-256; the digest in a record is its
    SHA-1) share one response, that of the smallest page_id; the others become revisits of it. Each task writes archives of about ARCHIVE bytes
    under names of its own, and per archive a run of entries sorted by URL key and time. The
    entries are a table that Spark writes, so archives of failed attempts are never read.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # without a shuffle of payloads if few are repeated
    linked = rows.join(small(stored(firsts, "firsts")), "sha", "left").select("page_id", "url", "payload", F.expr("if(page_id <=> first, null, first)").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(f"{folder}/archives")
        out, entries, size = None, [], 0

        def closed() -> pa.RecordBatch:
            out.close()
            entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[3]))
            key, time, page, offset = zip(*entries)
            names = {"url_key": key, "captured_at": time, "page_id": pa.array(page, pa.int64()), "archive": [name] * len(key), "offset": offset, "run": [name] * len(key), "at": range(len(key))}
            return pa.RecordBatch.from_pydict(names)

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, entries, size = system.open_output_stream(name, buffer_size=1 << 20), [], 0
                data = gzip.compress(record(page_id, url, html, base32_sha1(html), refers_to), 1, mtime=0)
                out.write(data)
                entries.append((url_key(url), captured(page_id), page_id, size))
                size += len(data)
                if size >= ARCHIVE:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    linked.mapInArrow(write, ENTRY).write.parquet(f"{folder}/runs")
    return pages.sparkSession.read.schema(ENTRY).parquet(f"{folder}/runs")


def merge_runs(entries: DataFrame, per_range: int = 200_000) -> DataFrame:
    """The captures in global order of URL key and time: by part, then by place within it.

    The key space is cut into ranges of about `per_range` entries, so that a task's memory
    doesn't grow with the input, and a URL with very many captures is cut by time and page too;
    each task merges the runs' shares of its range with a loser tree.
    """
    order = ["url_key", "captured_at", "page_id"]
    least = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-entries.count() // per_range))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for key, time, page, archive, offset, run, at in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(run, []).append((at, (key, time, page is not None, page or 0, archive, offset)))
        for run in runs.values():  # a shuffle may hand blocks of a run over in any order
            if any(a[0] > b[0] for a, b in zip(run, run[1:])):
                run.sort()
        rows, place = [], 0
        part = TaskContext.get().partitionId()
        for key, time, _, _, archive, offset in LoserTree([(e for _, e in run) for run in runs.values()]):
            rows.append((key, time, archive, offset, part, place))
            place += 1
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return entries.repartitionByRange(ranges, *order).mapInArrow(merge, MERGED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    key, time, archive, offset, part, place = zip(*rows)
    return pa.RecordBatch.from_pydict({"url_key": key, "captured_at": time, "archive": archive, "offset": offset, "part": pa.array(part, pa.int32()), "place": place})


def read_archives(entries: DataFrame) -> DataFrame:
    """A row per record of the archives that the entries name, parsed from the files alone.

    A response's digest and length are those of its payload; a revisit's come from its headers,
    as it has no payload. A payload that doesn't match its record's digest is an error.
    """
    archives = entries.select("archive").distinct()
    archives = one_per_task(archives, archives.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, _ = open_folder(archive.rpartition("/")[0])
                rows = []
                with system.open_input_stream(archive, buffer_size=1 << 20) as stream:
                    for at, member in members(stream):
                        rows.append((archive, at, *parsed(member)))
                for i in range(0, len(rows), 10_000):
                    columns = zip(*rows[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if j in (1, 2, 3, 6) else pa.string()) for j, c in enumerate(columns)], names=["archive", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.mapInArrow(read, RECORD)


def capture_histories(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages to archives, reads them back, and gives their rows with index places.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured_at
    and index_place, the capture's place in the merged index, from 0 without gaps. Null html is
    an empty payload; a null page_id or URL stays null or empty, and comes first. Any 64-bit
    page_id has a capture time (see captured), which may repeat; ties are in order of page_id.
    Rows that repeat the page_id of a response with the same payload are responses too. A
    payload of any length is one record. Other columns are ignored. No rows give no rows.
    """
    folder = run_folder(pages.sparkSession, "warc")
    entries = write_archives(pages.select("page_id", "url", "html"), folder, least)
    merge_runs(entries).write.parquet(f"{folder}/index")
    index = pages.sparkSession.read.schema(MERGED).parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part of the index
    starts = index.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    placed = index.join(starts, "part").select("archive", "offset", "url_key", "captured_at", (F.col("before") + F.col("place")).alias("index_place"))
    # Spark takes the parsed rows for as few as the archives they come from; so the join is named
    return read_archives(entries).hint("merge").join(placed, ["archive", "offset"]).drop("archive", "offset")
