"""WARC archives with revisit records, read back, and their index by an external merge.

Every page becomes one record, a gzip member of its own. Archives are stored as table rows (archive,
segment, content), since executors share only what Spark writes; `segment` rows joined in order are a
plain .warc.gz file. Reading back parses the records and rebuilds digests from the payloads.

The index is an external merge. The captures of each segment are a run, sorted when the segment is
read and stored in that order. Spark deals the stored runs to ranges of (URL key, timestamp, page), whose
number grows with the captures, so that a range has about RANGE_ROWS of them; a task streams the heads
of all runs of its range through a loser tree. Nothing is sorted again. Keys hold the page id, so one
hot URL is cut as well; captures with all of the key equal stay in one range.

Which of several equal payloads is the response depends on all pages: a hash aggregate over digests
finds the smallest page id. Only revisits are joined back; they are broadcast if at most
`broadcast_rows`, else shuffled.

Defined cases: a null html is an empty payload; a null url is written without a target; payloads
below `min_revisit_bytes` are always responses; a payload larger than a segment has one of its own; rows that share a page_id are written as given, and
equal ones are responses alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.base import written

SEGMENT_BYTES = 4_000_000
BROADCAST_ROWS = 200_000
RANGE_ROWS, MERGED_ROWS = 20_000, 2_000
READ_BYTES = 16_384
SLICE = 200
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324 - the format's digest


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then the rest, lower-cased; scheme and `www.` go."""
    host, slash, rest = re.sub(r"^[^:/?#]*://", "", url.lower(), count=1).partition("/")
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + slash + rest


def record(page: int, url: str | None, payload: bytes, refers: int | None) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {(EPOCH + timedelta(seconds=(page or 0) % 10**9)).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
        payload = b""
    head = "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""])
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", 5, mtime=0)


def records_in(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, headers and block of each gzip member; reads on in pieces of READ_BYTES."""
    view, at = memoryview(content), 0
    while at < len(view):
        member, raw, end = zlib.decompressobj(31), [], at
        while not member.eof:
            if end >= len(view):
                raise ValueError("a record is cut off")
            raw.append(member.decompress(view[end : end + READ_BYTES]))
            end = min(len(view), end + READ_BYTES)
        size = end - len(member.unused_data) - at
        head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield at, size, fields, rest[: int(fields["Content-Length"])]
        at += size


def revisits(pages: DataFrame, *, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload an earlier page id has."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    seen = pages.select("page_id", F.sha1(payload).alias("digest"), F.length(payload).alias("n")).where(F.col("n") >= min_revisit_bytes).select("page_id", "digest")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    return seen.join(first.drop("last"), "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, *, min_revisit_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Stored table (archive, segment, content) with a record for every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    again = written(revisits(pages, min_revisit_bytes=min_revisit_bytes), "revisits")
    again = F.broadcast(again) if again.count() <= broadcast_rows else again
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    rows = pages.withColumn("digest", digest).join(again, ["page_id", "digest"], "left")  # rows may share a page_id

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, segment, held, size = f"capture-{TaskContext.get().partitionId():06d}", 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([segment], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["archive", "segment", "content"])

        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(page, url, (html or "").encode(), refers))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield out()
                    segment, held, size = segment + 1, [], 0
        if held:
            yield out()

    return written(rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, "archive string, segment int, content binary"), "warc")


CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, segment int, at long, size long, run_pos long"
Key = tuple[str, str, int]


def capture_key(url: str, captured: str, page: int | None) -> Key:
    return url, captured, -(2**63) if page is None else page


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: the captures of a segment are a run, sorted here, with places `run_pos`. Digest and
    size of responses come from the payload that is read; a response whose payload doesn't have the digest
    that its header says is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, segment, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for at, size, h, block in records_in(content):
                    digest, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response" and (digest_of(block), len(block)) != (digest, n):
                        raise ValueError(f"record {h['WARC-Record-ID']} of {archive} is damaged")
                    page = h["WARC-Record-ID"][10:-1]
                    refers = int(h["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in h else None
                    rows.append((url_key(h.get("WARC-Target-URI", "")), h["WARC-Date"], None if page == "None" else int(page), n, digest, h["WARC-Type"], refers, archive, segment, at, size))
                rows.sort(key=lambda r: capture_key(*r[:3]))
                columns = [*zip(*rows), range(len(rows))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    return archives.select("archive", "segment", "content").mapInArrow(read, CAPTURE)


_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in CAPTURE.split(", ")]
ARROW = pa.schema(list(zip(_NAMES, _TYPES)))


class LoserTree:
    """k-way merge of sorted iterators: each inner node holds the loser of its match."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if not self._less(at, self.losers[node]):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def merge_index(captures: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures in global order of (url_key, captured, page_id): `range_no` and `place` in it. `captures` is
    the stored table of runs: it is counted, sampled by Spark for the ranges' bounds, and read."""
    ranges = max(1, -(-captures.count() // range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs: dict[tuple[str, int], list[tuple[int, int]]] = {}
        held = pa.Table.from_batches(batches, ARROW)
        for row, (archive, segment, pos) in enumerate(zip(*(held[c].to_pylist() for c in ("archive", "segment", "run_pos")))):
            runs.setdefault((archive, segment), []).append((pos, row))
        keys = [held[c].to_pylist() for c in ("url_key", "captured", "page_id")]

        def heads(rows: list[tuple[int, int]]) -> Iterator[tuple[Key, int]]:
            if any(a > b for a, b in zip(rows, rows[1:])):  # blocks of a run may arrive out of turn
                rows.sort()
            return ((capture_key(*(k[row] for k in keys)), row) for _, row in rows)

        order = [row for _, row in LoserTree([heads(runs[r]) for r in sorted(runs)])]
        number = TaskContext.get().partitionId()
        for at in range(0, len(order), MERGED_ROWS):
            part = held.take(order[at : at + MERGED_ROWS]).combine_chunks()
            more = [pa.array([number] * len(part), pa.int32()), pa.array(range(at, at + len(part)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in part.columns), *more], [*part.column_names, "range_no", "place"])

    return captures.repartitionByRange(ranges, "url_key", "captured", "page_id").mapInArrow(merge, CAPTURE + ", range_no int, place long")


def archive_pages(pages: DataFrame, *, min_revisit_bytes: int = 0) -> DataFrame:
    """Write, read back and index: one row per page."""
    archives = write_archives(pages, min_revisit_bytes=min_revisit_bytes)
    return merge_index(written(read_archives(archives), "captures"))
