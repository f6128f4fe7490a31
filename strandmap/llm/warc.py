"""WARC archives: writing with revisit records, and reading by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import drop, new_path, small_batches, small_or_as_is, stored

#: Fixed values of the format.
MAGIC = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FILE_BYTES, CHUNK_BYTES, HEAD_BYTES = 64 << 20, 4 << 20, 64 << 10
LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", re.I)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: an HTTP response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, out: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row, payload the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``min_bytes`` the one with the smallest id is the response, the others
    are revisits of it; smaller payloads are all responses. Rows that repeat that smallest id are responses too; a
    null id revisits the smallest one, and is a response where no row of its group has an id. Returns the manifest,
    a row a file: path, bytes, records. Other columns are not read. An empty table has no files.

    Only digests are grouped and joined; pages move only where the revisits are too many to be broadcast.
    """
    small_batches(pages.sparkSession)
    out = out or new_path(pages.sparkSession, "warc")
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("payload"))
    seen = stored(base.filter(F.length("payload") >= min_bytes).select("id", F.sha1("payload").alias("sha1"), F.length("payload").alias("n")), "digests")
    copied = stored(seen.groupBy("sha1", "n").agg(F.min("id").alias("first"), F.count("*").alias("c")).filter("c > 1 AND first IS NOT NULL"), "copied")
    again = seen.join(copied, ["sha1", "n"]).filter("id IS NULL OR id <> first").select("id", "sha1", "first").distinct()
    again = stored(again, "again")
    drop(seen, copied)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, u or "", p, r) for b in batches for i, u, p, r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        row, part = next(rows, None), 0
        while row is not None:
            path, size, n = f"{out}/part-{TaskContext.get().partitionId():06d}-{part:04d}.warc", 0, 0
            with files.committed(path) as f:
                while row is not None and size < FILE_BYTES:
                    data = record(*row, date)
                    f.write(data)
                    size, n, row = size + len(data), n + 1, next(rows, None)
            part += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    revisits = small_or_as_is(again.select(F.col("id").alias("rid"), F.col("sha1").alias("digest"), "first"))
    marked = base.join(revisits, F.col("id").eqNullSafe(F.col("rid")) & (F.sha1("payload") == F.col("digest")), "left")
    manifest = stored(marked.select("id", "url", "payload", "first").mapInArrow(write, "path string, bytes long, records long"), "manifest")
    drop(again)
    return manifest


def head_at(f: files.Ranged, data: bytes, base: int, at: int) -> tuple[bytes, int] | None:
    """Head of the record that starts at ``at`` and where its block starts; None if there is none whole."""
    i = at - base
    if data[i : i + len(MAGIC)] != MAGIC:
        return None
    end, n = data.find(b"\r\n\r\n", i), HEAD_BYTES
    if end >= 0:
        return data[i : end + 2], base + end + 4
    while True:  # the head goes beyond what has been read
        more = f.at(at, n)
        if (end := more.find(b"\r\n\r\n")) >= 0:
            return more[: end + 2], at + end + 4
        if len(more) < n or n > 64 * HEAD_BYTES:
            return None
        n *= 4


def successor(head: bytes, block: int) -> int | None:
    m = LENGTH.search(head)
    return block + int(m[1]) + 4 if m else None


def candidates(f: files.Ranged, start: int, end: int) -> list[tuple[int, int]]:
    """(offset, exit) of everything in a chunk that looks like a record; exit is the first offset beyond the
    chunk, or of no candidate, that following successors leads to."""
    data, found, i = f.at(start, end - start + HEAD_BYTES), [], 0
    while (i := data.find(MAGIC, i)) >= 0 and start + i < end:
        if (got := head_at(f, data, start, start + i)) and (to := successor(*got)):
            found.append((start + i, to))
        i += 1
    exits: dict[int, int] = {}
    for at, to in reversed(found):
        exits[at] = exits.get(to, to)
    return sorted(exits.items())


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def read_warc(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, payload: bool = False, id_col: str = "page_id") -> DataFrame:
    """The records of the archives, a row each: ``id_col``, payload_bytes, payload_digest, record_type, refers_to, url
    (and the payload, null for revisits, if asked for).

    Chunks of files are read independently: each task lists the offsets that look like a record and where their
    chains leave the chunk. Pointer jumping over these from offset 0, in as many rounds as the logarithm of the
    chunks of a file, keeps only what a chain from the file's start reaches; what a payload holds is never reached.
    Then each chunk is parsed from its first reached record. A payload whose digest differs from its head's is an
    error, as is a chain that does not end with its file.
    """
    spark = manifest.sparkSession
    small_batches(spark)
    step = F.lit(chunk_bytes)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), step.cast("long"))
    whole = manifest.select(F.xxhash64("path").alias("file"), "path", "bytes")
    pieces = whole.select("file", "path", F.explode(starts).alias("start"), "bytes").withColumn("end", F.least(F.col("start") + step, F.col("bytes")))
    sums = pieces.agg(F.count("*").alias("n"), F.max("start").alias("far")).head()
    n, rounds = max(1, sums["n"]), max(1, ((sums["far"] or 0) // chunk_bytes + 1).bit_length())
    pieces = stored(pieces.repartition(min(n, 10_000)), "pieces")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, path, start, end in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                f = files.Ranged(path)
                found = candidates(f, start, end)
                at, to = zip(*found, strict=True) if found else ((), ())
                f.close()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(to, pa.int64())], ["file", "at", "to"])

    # Offsets pack into small files, so Spark would think their table small enough to broadcast: merge joins instead.
    jump = stored(pieces.select("file", "path", "start", "end").mapInArrow(propose, "file long, at long, to long"), "jumps")
    reached = whole.select("file", F.lit(0).cast("long").alias("at"))
    old = [jump]
    for _ in range(rounds):
        further = reached.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = stored(reached.unionByName(further).distinct(), "reached")
        twice = jump.join(jump.select("file", F.col("at").alias("to"), F.col("to").alias("then")).hint("merge"), ["file", "to"])
        jump = stored(twice.select("file", "at", F.col("then").alias("to")), "jumps")
        old += [jump, reached]
    ended = whole.join(reached.hint("merge"), "file").groupBy("path", "bytes").agg(F.max("at").alias("last")).filter("last <> bytes")
    if lost := ended.limit(1).collect():
        raise ValueError(f"{lost[0]['path']}: the chain of records ends at {lost[0]['last']} of {lost[0]['bytes']} bytes")
    entries = reached.groupBy("file", (F.col("at") - F.pmod(F.col("at"), step)).alias("start")).agg(F.min("at").alias("entry"))
    todo = stored(pieces.join(entries.hint("merge"), ["file", "start"]).select("path", "entry", "end").filter("entry < end"), "todo")  # a file's end is no record
    drop(pieces, *old)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at, end in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                f, rows = files.Ranged(path), []
                base, data = at, f.at(at, end - at + HEAD_BYTES)
                while at < end:
                    head, block = head_at(f, data, base, at)
                    to = successor(head, block)
                    body = data[block - base : to - 4 - base] if to <= base + len(data) else f.at(block, to - 4 - block)
                    h = fields(head)
                    http, _, content = body.partition(b"\r\n\r\n")
                    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        size = len(content)
                        if base32_sha1(content) != digest:
                            raise ValueError(f"{path}: the payload at {at} doesn't have the digest of its head")
                    else:
                        size, content = int(LENGTH.search(http + b"\r\n")[1]), None
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    rows.append((number("x-page-id"), size, digest, kind, number("x-refers-to-page-id"), h.get("warc-target-uri"), content.decode("utf-8") if payload and content is not None else None))
                    at = to
                f.close()
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 6 + payload], [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 6 + payload])

    kind = f"`{id_col}` long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload string" * payload
    return todo.repartition(min(n, 10_000)).mapInArrow(parse, kind)
