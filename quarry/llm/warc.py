"""WARC archives as chunked record tables.

A record is rows ``(record, chunk_no, chunk)`` of at most ``CHUNK`` bytes.  The
writer and the reader take a payload chunk by chunk, with its SHA-1 up to and
including each, so neither holds one whole.  Only Spark's row of the pages does,
which chunks are cut from one at a time where it is read: payloads are neither
shuffled nor put together again.
Archives are WARC 1.1, a gzip member per record.  The writer returns places at
which readers may start, so one archive is read by many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TaskFile, hinted, open_fs, scratch, written

CHUNK = 256 << 10
#: Compressed bytes after which a reader's stretch ends, and after which an archive ends.
STRETCH, ARCHIVE = 16 << 20, 1 << 30
NAME = "urn:record:"


def duplicates(records: DataFrame, least: int = 1000) -> DataFrame:
    """``(payload_digest, payload_bytes, responder)`` of payloads that several records share."""
    large = records.select("payload_digest", "payload_bytes", "record").filter(F.col("payload_bytes") >= least)
    groups = large.groupBy("payload_digest", "payload_bytes").agg(F.max("record").alias("responder"), F.count("*").alias("n"))
    return groups.filter("n > 1 AND responder IS NOT NULL").drop("n")


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table to be written.

    Records with equal payloads of at least ``least`` bytes revisit the one with
    the largest id (all rows that carry this id are responses); a null id never
    answers for others.  A null payload is empty; an empty one is one empty
    chunk.  A revisit has no payload of its own, so one empty chunk.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    records = pages.select(F.col(id_col).alias("record"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    records = records.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})
    shared = hinted(written(duplicates(records, least), "shared_payloads"))
    joined = records.join(shared, ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("responder") != F.col("record"), F.col("responder").isNotNull())
    joined = joined.select(
        "record", "url", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("responder")).alias("refers_to"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )
    last = F.greatest(F.lit(0), F.expr(f"(octet_length(payload) - 1) div {chunk}")).cast("int")
    numbered = joined.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    piece = F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return numbered.select(*[c for c in joined.columns if c != "payload"], "chunk_no", piece.alias("chunk"), (F.col("chunk_no") == last).alias("last"))


def header_url(url: str | None) -> str | None:
    """A url as a header has it: white space around it goes, other white space and control characters are percent-encoded."""
    return None if url is None else "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url.strip())


def _member(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def write_warc(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes a chunked record table, whose records' chunks follow one another; gives stretches ``(file, at, size)``."""

    def write(batches):
        from pyspark import TaskContext

        task, part, to, sha, packer, begin = TaskContext.get().partitionId(), 0, None, None, None, 0
        places: list[tuple[str, int, int]] = []

        def closed():
            nonlocal to
            if to.size > begin:
                places.append((to.uri, begin, to.size - begin))
            to.close()
            to = None

        for batch in batches:
            for r in batch.to_pylist():
                if to is None:
                    to, begin = TaskFile(folder, f"part-{task:06d}-{part:04d}.warc.gz"), 0
                    part += 1
                revisit = r["record_type"] == "revisit"
                if r["chunk_no"] == 0:
                    sha, packer = hashlib.sha1(), zlib.compressobj(6, zlib.DEFLATED, 31)
                    digest = base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()
                    head = _member([
                        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", f"<{NAME}{'' if r['record'] is None else r['record']}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
                        ("WARC-Target-URI", header_url(r["url"])), ("WARC-Refers-To", f"<{NAME}{r['refers_to']}>" if revisit else None),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
                        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", r["payload_bytes"]),
                        ("Content-Type", "text/html"), ("Content-Length", 0 if revisit else r["payload_bytes"]),
                    ])
                    to.write(packer.compress(head))
                sha.update(r["chunk"])
                to.write(packer.compress(r["chunk"]))
                if r["last"]:
                    if not revisit and sha.hexdigest() != r["payload_digest"]:
                        raise ValueError(f"the chunks of record {r['record']} are not its payload")
                    to.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    if to.size - begin >= STRETCH:
                        places.append((to.uri, begin, to.size - begin))
                        begin = to.size
                    if to.size >= ARCHIVE:
                        closed()
        if to is not None:
            closed()
        if places:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*places)], names=["file", "at", "size"])

    return written(chunks.mapInArrow(write, "file string, at bigint, size bigint"), "warc_places")


class _Source:
    """Bytes of a stretch of gzip members, unpacked as they are asked for."""

    def __init__(self, file, at: int, size: int):
        file.seek(at)
        self.file, self.left, self.buffer, self.packed, self.unpack = file, size, b"", b"", None

    def _fill(self) -> bool:
        while True:
            if not self.packed:
                if not self.left:
                    return False
                self.packed = self.file.read(min(CHUNK, self.left))
                self.left -= len(self.packed)
            self.unpack = self.unpack or zlib.decompressobj(31)
            got = self.unpack.decompress(self.packed, CHUNK)
            if self.unpack.eof:
                self.packed, self.unpack = self.unpack.unused_data, None
            else:
                self.packed = self.unpack.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n and self._fill():
            pass
        if len(self.buffer) < n:
            raise ValueError("an archive ends inside a record")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def header(self) -> dict[str, str] | None:
        while b"\r\n\r\n" not in self.buffer:
            if not self._fill():
                if self.buffer:
                    raise ValueError("an archive ends inside a header")
                return None
        head, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        return dict(line.split(": ", 1) for line in lines[1:])


READ = "record bigint, url string, record_type string, refers_to bigint, chunk_no int, last boolean, chunk_bytes bigint, bytes_so_far bigint, sha1_so_far string, payload_bytes bigint, payload_digest string"


def read_warc(places: DataFrame, with_data: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of archives: a row per chunk, with count and SHA-1 of the payload so far (and its bytes).

    Raises if a payload does not match its record's digest.
    """
    names = [x.split()[0] for x in READ.split(", ")] + ["chunk"] * with_data

    def number(urn: str | None) -> int | None:
        text = (urn or "").strip("<>").removeprefix(NAME)
        return int(text) if text else None

    def rows(file: str, at: int, size: int):
        fs, path = open_fs(file)
        with fs.open_input_file(path) as f:
            source = _Source(f, at, size)
            while (head := source.header()) is not None:
                left, done, no, sha = int(head["Content-Length"]), 0, 0, hashlib.sha1()
                digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                while no == 0 or left:
                    data = source.read(min(chunk, left))
                    left, done = left - len(data), done + len(data)
                    sha.update(data)
                    so_far = sha.hexdigest()
                    if not left and head["WARC-Type"] == "response" and so_far != digest:
                        raise ValueError(f"{file}: a payload doesn't match its digest")
                    yield (number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], number(head.get("WARC-Refers-To")), no, not left, len(data), done, so_far, int(head["X-Payload-Length"]), digest, *([data] * with_data))
                    no += 1
                source.read(4)

    def read(batches):
        held, size = [], 0
        for batch in batches:
            for place in batch.to_pylist():
                for row in rows(place["file"], place["at"], place["size"]):
                    held.append(row)
                    size += 200 + row[6] * with_data
                    if size >= 4 << 20:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_data
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    # a task per stretch: a row is a few bytes here, and 16 MB of archive
    return places.repartition(max(1, places.count()), "file", "at").mapInArrow(read, READ + ", chunk binary" * with_data)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes a record per page to the shared folder and reads the archives back: one row per record."""
    places = write_warc(chunk_table(pages, least=least), scratch(pages.sparkSession, "warc"))
    own = F.col("record_type") == "response"
    return read_warc(places).filter("last").select(
        F.col("record").alias("page_id"),
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("sha1_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to", "url",
    )
