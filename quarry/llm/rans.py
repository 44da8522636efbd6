"""Token ids in binary files, compressed by a static range asymmetric numeral system.

File: segments, each with a frequency table that all its blocks share, then an
index of segments and documents.  A block holds ``BLOCK`` ids dealt over
``LANES`` interleaved coders; its bit stream is 32-bit words.  Every ``ROWS``
rows a checkpoint keeps the coders' states and the place in the stream, so all
stretches between checkpoints, of all blocks, decode side by side: numpy runs
them as one array.  A block carries the CRC-32 of its words and of its ids.

Coder: 64-bit state x in [2^31, 2^63), table total 2^k; symbol with frequency f
and cumulated frequency c takes x to ((x // f) << k) + x % f + c after giving off
32 bits if x >= f << (63 - k).
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .common import TaskFile, crc_ids, merge_blocks, open_fs, scratch, text_bytes, written

LANES, BLOCK, ROWS = 32, 1 << 16, 512
#: Ids that share a frequency table; a task holds about this many at once.
SEGMENT = 4 << 20
#: Ids after which a task goes on in a further file: about 100 MB of text ids, and an index of a few megabytes.
FILE = 64 << 20
MAGIC = b"rANSids1"
LOW = np.uint64(1 << 31)


def frequencies(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of a total 2^k, at least one for each id counted; and k."""
    n = np.count_nonzero(counts)
    k = min(24, max(14, int(np.ceil(np.log2(max(n, 1)))) + 4))
    total = 1 << k
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * total // max(counts.sum(), 1)), 0).astype(np.int64)
    need = total - int(f.sum())
    if need > 0:
        f[np.argmax(f)] += need
    for i in np.argsort(-f):
        if need >= 0:
            break
        take = min(int(f[i]) // 2, -need)
        f[i] -= take
        need += take
    return f, k


def encode_blocks(ids: np.ndarray, f: np.ndarray, k: int) -> list[bytes]:
    """Blocks of ids (nonempty, each counted in f), coded side by side."""
    n_blocks = -(-len(ids) // BLOCK)
    sizes = np.full(n_blocks, BLOCK)
    sizes[-1] = len(ids) - BLOCK * (n_blocks - 1)
    start = np.cumsum(f) - f
    f, start = f.astype(np.uint64), start.astype(np.uint64)
    lane = np.arange(LANES)
    x = np.full((n_blocks, LANES), LOW, np.uint64)
    shift, word, sh = np.uint64(63 - k), np.uint64(32), np.uint64(k)
    padded = np.zeros(n_blocks * BLOCK, np.int64)
    padded[: len(ids)] = ids
    symbols = padded.reshape(n_blocks, BLOCK // LANES, LANES)
    n_rows = -(-sizes // LANES)
    states = [[] for _ in range(n_blocks)]
    counts = np.zeros((n_blocks, BLOCK // LANES), np.int64)
    given: list[tuple[np.ndarray, np.ndarray]] = []
    for row in range(int(n_rows.max()) - 1, -1, -1):
        live = row * LANES + lane < sizes[:, None]
        s = symbols[:, row, :]
        fs = np.where(live, f[s], np.uint64(1))
        out = live & (x >= (fs << shift)) & ((fs >> sh) == 0)
        if out.any():
            given.append((np.nonzero(out)[0], (x[out] & np.uint64(0xFFFFFFFF)).astype("<u4")))
            counts[:, row] = out.sum(1)
            x = np.where(out, x >> word, x)
        q = x // fs
        x = np.where(live, (q << sh) + (x - q * fs) + start[s], x)
        if row % ROWS == 0:
            for b in np.flatnonzero(n_rows > row):
                states[b].append(x[b].copy())
    # rows came last first; within a row a block's words are in lane order
    given.reverse()
    block_of = np.concatenate([g[0] for g in given]) if given else np.zeros(0, np.int64)
    words = np.concatenate([g[1] for g in given]) if given else np.zeros(0, "<u4")
    order = np.argsort(block_of, kind="stable")
    parts = np.split(words[order], np.cumsum(np.bincount(block_of, minlength=n_blocks))[:-1])
    out = []
    for b in range(n_blocks):
        marks = len(states[b])
        offsets = np.concatenate([[0], np.cumsum(counts[b])])[: marks * ROWS : ROWS].astype("<u4")
        body = np.stack(states[b][::-1]).astype("<u8").tobytes() + offsets.tobytes() + parts[b].tobytes()
        own = ids[b * BLOCK : b * BLOCK + sizes[b]]
        out.append(struct.pack("<5I", sizes[b], marks, len(parts[b]), zlib.crc32(body), crc_ids(own)) + body)
    return out


def decode_blocks(blocks: list[bytes], f: np.ndarray, k: int) -> np.ndarray:
    """Ids of blocks; all stretches between their checkpoints are decoded side by side.  Raises if a checksum fails."""
    heads = [struct.unpack_from("<5I", b) for b in blocks]
    states, pointers, words, sizes, base = [], [], [], [], 0
    for (n, marks, n_words, crc, _), b in zip(heads, blocks):
        if zlib.crc32(memoryview(b)[20:]) != crc:
            raise ValueError("a block's bytes don't match their checksum")
        states.append(np.frombuffer(b, "<u8", marks * LANES, 20).reshape(marks, LANES))
        at = 20 + 8 * marks * LANES
        pointers.append(np.frombuffer(b, "<u4", marks, at).astype(np.int64) + base)
        words.append(np.frombuffer(b, "<u4", n_words, at + 4 * marks))
        sizes += [min(ROWS * LANES, n - m * ROWS * LANES) for m in range(marks)]
        base += n_words
    x, at = np.concatenate(states).astype(np.uint64), np.concatenate(pointers)
    words = np.append(np.concatenate(words), np.uint32(0)).astype(np.uint64)
    sizes = np.array(sizes)
    start = np.cumsum(f) - f
    symbol = np.repeat(np.arange(len(f), dtype=np.uint32), f)
    f, start = f.astype(np.uint64), start.astype(np.uint64)
    mask, sh, word = np.uint64((1 << k) - 1), np.uint64(k), np.uint64(32)
    lane, out = np.arange(LANES), np.zeros((len(sizes), ROWS, LANES), np.uint32)
    for row in range(-(-int(sizes.max()) // LANES)):
        live = row * LANES + lane < sizes[:, None]
        low = x & mask
        s = symbol[low]
        out[:, row, :] = s
        y = f[s] * (x >> sh) + low - start[s]
        need = live & (y < LOW)
        rank = np.cumsum(need, 1)
        place = np.minimum(at[:, None] + rank - 1, len(words) - 1)
        x = np.where(live, np.where(need, (y << word) | words[np.maximum(place, 0)], y), x)
        at += rank[:, -1]
    ids = np.concatenate([o.reshape(-1)[:n] for o, n in zip(out, sizes)])
    done = 0
    for n, _, _, _, crc in heads:
        if crc_ids(ids[done : done + n]) != crc:
            raise ValueError("a block's ids don't match their checksum")
        done += n
    return ids


class _IdFile:
    """A file of ids: segments of rANS blocks behind the magic, then an index of segments and documents."""

    def __init__(self, folder: str, name: str):
        self.to = TaskFile(folder, name)
        self.to.write(MAGIC)
        self.index: dict = {"segments": [], "docs": [], "n": []}
        self.held, self.size, self.total = [], 0, 0

    def add(self, docs: list, counts: list[int], ids: np.ndarray) -> None:
        self.index["docs"] += docs
        self.index["n"] += counts
        self.total += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        while self.size >= SEGMENT:
            joined = np.concatenate(self.held)
            self._segment(joined[:SEGMENT])
            self.held, self.size = [joined[SEGMENT:]], len(joined) - SEGMENT

    def _segment(self, ids: np.ndarray) -> None:
        f, k = frequencies(np.bincount(ids))
        used = np.flatnonzero(f)
        table = zlib.compress(np.diff(used, prepend=0).astype("<u4").tobytes() + f[used].astype("<u4").tobytes(), 1)
        at, places = self.to.size, []
        self.to.write(table)
        for block in encode_blocks(ids, f, k):
            places.append(len(block))
            self.to.write(block)
        self.index["segments"].append({"at": at, "table": len(table), "k": k, "blocks": places, "n": len(ids)})

    def close(self) -> None:
        if self.size:
            self._segment(np.concatenate(self.held))
        tail = zlib.compress(json.dumps(self.index).encode())
        self.to.write(tail + struct.pack("<QI", len(tail), zlib.crc32(tail)) + MAGIC)
        self.to.close()


def write_ids(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, file_ids: int = FILE) -> DataFrame:
    """Writes the ids of every text, each followed by the end id, in ascending order of id; gives ``(file, number, part, n_ids)``.

    Documents are dealt by ranges of their id, so file after file holds them in
    order (null ids first; equal ids by the text's hash).  A range goes on in a
    further file once one has ``file_ids`` ids; a document lies in one file.
    Files appear whole or not at all.  A null or empty text has the end id alone.
    """

    def write(batches):
        from pyspark import TaskContext

        from .tokenids import worker_encoder

        number, part, encoder, out = TaskContext.get().partitionId(), 0, worker_encoder(tokenizer), None
        done = lambda: pa.RecordBatch.from_pydict({"file": [out.to.uri], "number": pa.array([number], pa.int32()), "part": pa.array([part], pa.int32()), "n_ids": [out.total]})
        for batch in merge_blocks(batches, limit=min(8 << 20, 4 * file_ids)):
            if out is None:
                out = _IdFile(folder, f"ids-{number:06d}-{part:05d}.rans")
            ids, at = encoder.encode(text_bytes(batch.column(1)))
            out.add(batch.column(0).to_pylist(), (np.diff(at) + 1).tolist(), np.insert(ids, at[1:], np.uint32(end_id)))
            if out.total >= file_ids:
                out.close()
                yield done()
                part, out = part + 1, None
        if out is not None:
            out.close()
            yield done()

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    dealt = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(dealt.mapInArrow(write, "file string, number int, part int, n_ids bigint"), "ids_manifest")


def read_ids(manifest: DataFrame, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """A row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""

    kind = to_arrow_type(_parse_datatype_string(id_type))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_file(row["file"], row["start"], with_ids, kind)

    starts = manifest.select("file", (F.sum("n_ids").over(Window.orderBy("number", "part")) - F.col("n_ids")).alias("start"))  # a row per file
    out = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    # a task per file: a row is a few bytes here, and megabytes of ids
    return starts.repartition(max(1, manifest.count()), "file").mapInArrow(read, out)


def _read_file(uri: str, start: int, with_ids: bool, kind: pa.DataType):
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as source:
        size = source.size()
        source.seek(size - 20)
        n, crc = struct.unpack("<QI", source.read(20)[:12])
        source.seek(size - 20 - n)
        if zlib.crc32(tail := source.read(n)) != crc:
            raise ValueError(f"{uri}: the index doesn't match its checksum")
        index = json.loads(zlib.decompress(tail))
        docs, lengths = index["docs"], index["n"]
        at, left, sums, parts, rows = 0, lengths[0], 0, [], []
        for seg in index["segments"]:
            source.seek(seg["at"])
            raw = np.frombuffer(zlib.decompress(source.read(seg["table"])), "<u4").reshape(2, -1)
            used = np.cumsum(raw[0], dtype=np.int64)
            f = np.zeros(used[-1] + 1, np.int64)
            f[used] = raw[1]
            ids = decode_blocks([source.read(b) for b in seg["blocks"]], f, seg["k"]).astype("<u4")
            done = 0
            while done < len(ids):
                part = ids[done : done + left].tobytes()
                sums = zlib.crc32(part, sums)
                if with_ids:
                    parts.append(part)
                done += len(part) // 4
                left -= len(part) // 4
                if not left:
                    rows.append((docs[at], start, lengths[at], sums, b"".join(parts)))
                    start += lengths[at]
                    at, sums, parts = at + 1, 0, []
                    left = lengths[at] if at < len(docs) else 0
            if rows:
                columns = list(zip(*rows))[: 5 if with_ids else 4]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *map(pa.array, columns[1:])], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                rows = []


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of ``documents`` to the shared folder and reads the files back."""
    manifest = write_ids(docs, scratch(docs.sparkSession, "token_ids"), tokenizer, end_id=end_id)
    return read_ids(manifest, docs.schema["doc_id"].dataType.simpleString())
