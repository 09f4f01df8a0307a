"""Writing pages as WARC archives and reading them back, with segment reassembly.

Payloads are numbered first: of equal ones of ``least`` bytes or more, the page with the smallest
page_id is the response and the others become revisit records. Each task then writes its records to
archive files of bounded size in the shared folder. A response's HTTP message is framed in chunks;
where its block is longer than a segment it is cut, and the rest goes into continuation records with
the first record's id as origin, which may lie in a later file. Reading takes whole archive files
with Spark's binary reader, groups segments by origin, orders them by number, verifies the total
length, and decodes the chunks.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import new_path

CRLF = b"\r\n"
#: Pages have no date of their own; with one date for all, the same pages give the same files.
DATE = "2000-01-01T00:00:00Z"
SEGMENT = "origin string, number int, type string, total long, page_id string, url string, refers string, digest string, length long, block binary"


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload within chunked framing; a broken frame is an error."""
    out, at = [], 0
    while True:
        line = body.index(CRLF, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size
        if len(out[-1]) != size or body[at : at + 2] != CRLF:
            raise ValueError("a chunk is cut short")
        at += 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record as a gzip member of its own."""
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", len(block))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head + CRLF + block + CRLF + CRLF) + packer.flush()


def header_text(value: str | None) -> str:
    """A header value on one line; a null has no value."""
    return "" if value is None else re.sub(r"%|[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, refers_url: str | None, revisit: bool, place: str, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: one, or a first segment and its continuations; ``place`` is the row's own."""
    name = "null" if page_id is None else str(page_id)
    # The row's place goes into the name too, so that rows which repeat a page have records of their own.
    origin = f"<urn:sha1:{hashlib.sha1(f'{name} {url} {digest} {place}'.encode('utf-8', 'surrogatepass')).hexdigest()}>"
    fields = [("WARC-Record-ID", origin), ("WARC-Date", DATE), ("X-Page-ID", name), ("WARC-Target-URI", header_text(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload))]
    if revisit:
        fields += [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", header_text(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", refers)]
        yield record(fields, b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), *fields], block)
        return
    yield record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = f"<urn:sha1:{hashlib.sha1(f'{origin} {k}'.encode()).hexdigest()}>"
        more = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", k), *more], part)


def classified(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html, digest, refers, refers_url, revisit for every row."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.sha2(body, 256).alias("digest"))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = firsts.select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    found = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers"), F.when(revisit, F.col("first_url")).alias("refers_url"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least: int = 100, segment: int = 16 << 10, chunk: int = 4 << 10, file_bytes: int = 4 << 20) -> None:
    """Writes gzip-compressed WARC files to ``folder``, a URI that executors can write to."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        held, size, files = [], 0, 0

        def flush() -> None:
            # A task that runs again writes the same file anew; the name only appears when it is whole.
            nonlocal held, size, files
            if held:
                name = f"{context.partitionId():06d}-{files:05d}"
                part = f"{base}/.{name}.{context.taskAttemptId()}"
                with store.open_output_stream(part, compression=None) as out:
                    for x in held:
                        out.write(x)
                final = f"{base}/{name}.warc.gz"
                if store.get_file_info(final).type == fs.FileType.File:  # some stores refuse to replace a file
                    store.delete_file(final)
                store.move(part, final)
                held, size, files = [], 0, files + 1

        records, rows = 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers, refers_url, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers", "refers_url", "revisit")), strict=True):
                rows += 1
                for raw in page_records(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers, refers_url, revisit, f"{context.partitionId()}-{rows}", segment, chunk):
                    held.append(raw)
                    size += len(raw)
                    records += 1
                    if size >= file_bytes:
                        flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([records], pa.int64())], names=["records"])

    # Rows come in an order of their own, so that a task that runs again writes the same files.
    rows = classified(pages, least).sortWithinPartitions("digest", "page_id", "url")
    rows.mapInArrow(run, "records long").agg(F.sum("records")).collect()


def members(raw: bytes, piece: int = 64 << 10) -> Iterator[bytes]:
    """The contents of the gzip members of a file. It is read in pieces, so that what follows a member is never copied whole."""
    view, at = memoryview(raw), 0
    while at < len(view):
        opener, out = zlib.decompressobj(31), []
        while not opener.eof:
            if at >= len(view):
                raise ValueError("the file ends within a record")
            part = view[at : at + piece]
            out.append(opener.decompress(part))
            at += len(part) - len(opener.unused_data)
        yield b"".join(out)


def parsed(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive file."""
    for data in members(raw):
        head, _, rest = data.partition(CRLF + CRLF)
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        if len(rest) != size + 4 or not rest.endswith(CRLF + CRLF):
            raise ValueError(f"the record {fields.get('WARC-Record-ID')} is cut short")
        yield fields, rest[:size]


def read_segments(archives: DataFrame) -> DataFrame:
    """A row for each record of the archive files (column ``content``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows = []
                for f, block in parsed(raw.as_py()):
                    origin = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
                    total = f.get("WARC-Segment-Total-Length")
                    alone = "WARC-Segment-Number" not in f
                    length = f.get("X-Payload-Length")
                    rows.append((origin, 0 if alone else int(f["WARC-Segment-Number"]), f["WARC-Type"], None if total is None else int(total), f.get("X-Page-ID"), f.get("WARC-Target-URI"), f.get("X-Refers-To-Page"), f.get("WARC-Payload-Digest"), None if length is None else int(length), block))
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = [x.split()[0] for x in SEGMENT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("content").mapInArrow(run, SEGMENT)


def decoded(messages: DataFrame) -> DataFrame:
    """page_id, payload, payload_bytes, payload_digest, record_type, refers_to from whole messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, page, refers, digest, length, block in zip(*(batch.column(c).to_pylist() for c in ("type", "page_id", "refers", "digest", "length", "block")), strict=True):
                page_id, digest = None if page == "null" else int(page), digest.removeprefix("sha256:")
                if kind == "revisit":
                    rows.append((page_id, None, length, digest, kind, None if refers == "None" else int(refers)))
                    continue
                head, _, body = b"".join(block).partition(CRLF + CRLF)
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"the payload of page {page} does not match its digest")
                rows.append((page_id, payload, len(payload), found, kind, None))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return messages.mapInArrow(run, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole messages, each as the list of its parts: records that stand alone, and segments by origin in order of number.

    A message whose segments have a gap or do not add up to the total length is an error.
    """
    whole = segments.where("number = 0").select("type", "page_id", "refers", "digest", "length", F.array("block").alias("block"))
    parts = segments.where("number > 0").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("refers").alias("refers"), F.max("digest").alias("digest"), F.max("length").alias("length")
    )
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    joined = parts.select(F.lit("response").alias("type"), "page_id", "refers", "digest", "length", F.transform("parts", lambda p: p["block"]).alias("block"), size.alias("size"), "total", (F.size("parts") == F.get("parts", F.size("parts") - 1)["number"]).alias("gapless"))
    sound = F.coalesce(F.col("gapless") & (F.col("size") == F.col("total")), F.lit(False))
    checked = joined.withColumn("block", F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments of page "), "page_id", F.lit(" do not add up")))))
    return whole.unionByName(checked.select(*whole.columns))


def round_trip(pages: DataFrame, least: int = 100, **sizes: int) -> DataFrame:
    """Writes the pages to archives in the shared folder and returns what reading these gives:
    page_id, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Payloads under ``least`` bytes are all responses. A null page_id
    is never the smallest of a group that has another; if it has no other, all are responses. Rows
    that repeat page_id and payload for the smallest page_id are each a response. A null url is an
    empty header. An empty table gives no rows; other columns are ignored.
    """
    folder = new_path(pages.sparkSession, "warc")
    write_archives(pages, folder, least, **sizes)
    reader = pages.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary")
    return decoded(reassembled(read_segments(reader.load(folder))))
