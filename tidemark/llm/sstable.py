"""Token ids in sorted-string-table shards.

A shard holds one range of keys in ascending order:

    block*      zstd of: n entries, each (varint: key bytes shared with the entry before, varint: key bytes that
                follow, varint: tokens, those key bytes); then all ids of the block, 2 bytes each if they fit, else 4
    index       an entry for each block: its first key, offset, length, crc32
    Bloom       bits over all keys, 7 probes a key
    footer      fixed size: where index and Bloom filter lie, counts, id width, magic

A key is 9 bytes: 0 for a null identifier (which sorts first) or 1, then the identifier, big-endian with its sign
flipped, so bytes sort as numbers do. A look-up reads footer, filter and index, then the one block that binary search
finds. Spark deals the documents out by key range, sorts each range, and each task writes its shard under a name of
its own and moves it into place, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, shared_path
from .pieces import pieces

BLOCK_BYTES = 64 * 1024
BITS_A_KEY, PROBES = 10, 7
MAGIC = b"TIDESST1"
FOOTER = struct.Struct("<QQQQQQI8s")


class Folder:
    """Files of a folder that all executors share: by a local path, or by any store that Arrow can open."""

    def __init__(self, uri: str):
        self.fs = None
        if uri.startswith("file:") or "://" not in uri:
            self.path = "/" + uri.removeprefix("file:").lstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def create(self, name: str):
        if self.fs is None:
            os.makedirs(self.path, exist_ok=True)
            return open(f"{self.path}/{name}", "wb")
        self.fs.create_dir(self.path)
        return self.fs.open_output_stream(f"{self.path}/{name}")

    def move(self, name: str, to: str) -> None:
        (os.replace if self.fs is None else self.fs.move)(f"{self.path}/{name}", f"{self.path}/{to}")

    def open(self, name: str):
        return open(f"{self.path}/{name}", "rb") if self.fs is None else self.fs.open_input_file(f"{self.path}/{name}")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Writes one shard from (identifier, ids as little-endian 32-bit bytes) in key order."""

    def __init__(self, out, wide: bool, block_bytes: int = BLOCK_BYTES):
        self.out, self.wide, self.block_bytes = out, wide, block_bytes
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.at = self.docs = self.tokens = 0
        self.index, self.keys = bytearray(), []
        self._begin()

    def _begin(self):
        self.entries, self.values, self.size, self.first, self.last, self.n = bytearray(), [], 0, b"", b"", 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key, shared = key_of(doc_id), 0
        if self.n:
            shared = len(os.path.commonprefix([key, self.last]))
        else:
            self.first = key
        self.entries += varint(shared) + varint(len(key) - shared) + varint(len(ids) // 4) + key[shared:]
        self.values.append(ids)
        self.size += len(ids)
        self.last = key
        self.n += 1
        self.docs += 1
        self.tokens += len(ids) // 4
        self.keys.append(key)
        if self.size >= self.block_bytes:
            self.flush()

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        if not self.n:
            return
        ids = b"".join(self.values)
        if not self.wide:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        at = self.at
        data = self.zstd.compress(struct.pack("<II", self.n, len(self.entries)) + bytes(self.entries) + ids)
        self.index += self.first + struct.pack("<QII", at, self._put(data), zlib.crc32(data))
        self._begin()

    def close(self) -> None:
        self.flush()
        bits = max(64, (self.docs * BITS_A_KEY + 7) // 8 * 8)
        bloom = np.zeros(bits, np.bool_)
        for key in self.keys:
            bloom[probes(key, bits)] = True
        index_at, index_n = self.at, self._put(bytes(self.index))
        bloom_at, bloom_n = self.at, self._put(np.packbits(bloom).tobytes())
        self._put(FOOTER.pack(index_at, index_n, bloom_at, bloom_n, self.docs, self.tokens, self.wide, MAGIC))


class Reader:
    """Reads a shard: scan() gives (identifier, ids as little-endian 32-bit bytes) in order, get() all values of one key."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2) if not hasattr(file, "size") else file.size()
        footer = self._read((end if isinstance(end, int) else file.tell()) - FOOTER.size, FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.docs, self.tokens, self.wide, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, step = self._read(index_at, index_n), 9 + 16
        self.index = [(raw[i : i + 9], *struct.unpack("<QII", raw[i + 9 : i + step])) for i in range(0, index_n, step)]
        self.bloom = np.frombuffer(self._read(bloom_at, bloom_n), np.uint8)
        self.blocks_read = 0

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[int | None, bytes]]:
        _, at, n, crc = self.index[i]
        data = self._read(at, n)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        self.blocks_read += 1
        raw = zstandard.ZstdDecompressor().decompress(data)
        count, entries = struct.unpack("<II", raw[:8])
        ids, width = raw[8 + entries :], 4 if self.wide else 2
        pos, key, start = 8, b"", 0
        for _ in range(count):
            shared, pos = read_varint(raw, pos)
            own, pos = read_varint(raw, pos)
            tokens, pos = read_varint(raw, pos)
            key = key[:shared] + raw[pos : pos + own]
            pos += own
            value = ids[start : start + tokens * width]
            start += tokens * width
            yield id_of(key), value if self.wide else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in probes(key_of(doc_id), len(self.bloom) * 8))

    def get(self, doc_id: int | None) -> list[bytes]:
        if not self.may_hold(doc_id):
            return []
        key, out = key_of(doc_id), []
        i = max(0, bisect_right([x[0] for x in self.index], key) - 1)
        while i > 0 and self.index[i][0] == key:
            i -= 1
        while i < len(self.index) and self.index[i][0] <= key:
            out += [v for k, v in self.block(i) if k == doc_id]
            i += 1
        return out


def _write(path: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, store, writer = TaskContext.get().partitionId(), Folder(folder), None
        enc, end = pieces(path), struct.pack("<I", end_id)
        name, own = f"shard-{shard:06d}.sst", f".{shard:06d}-{uuid.uuid4().hex}"
        wide = max(end_id, enc.tokenizer.get_vocab_size(with_added_tokens=True)) > 65535
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if writer is None:
                        out = store.create(own)
                        writer = Writer(out, wide)
                    writer.add(doc_id, enc.ids(text.as_py() or "") + end)
            if writer is None:
                return
            writer.close()
        except BaseException:
            with suppress(Exception):
                out.close()
                os.unlink(f"{store.path}/{own}")
            raise
        out.close()
        store.move(own, name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [writer.docs], "n_tokens": [writer.tokens]})

    return run


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 2, shards: int | None = None) -> list:
    """Encodes documents (doc_id long, text string) with the tokenizer at path, end_id behind each, and writes them to
    `folder` in ascending order of (doc_id, text). Returns one row for each shard, in order: shard, name, n_docs, n_tokens.

    Null texts are empty; rows with a null doc_id come first; repeated identifiers keep all their rows. Other
    columns are not written. An empty table writes no shard. The list is as long as there are shards."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(mapped(dealt, _write(path, folder, end_id), "shard long, name string, n_docs long, n_tokens long").collect())


def _scan(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Folder(folder)
        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open(name) as file:
                    reader, rows, size = Reader(file), [], 0
                    for doc_id, ids in reader.scan():
                        rows.append((doc_id, start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        size += len(ids)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    return run


def read_shards(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """The documents of all shards: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    starts, at = [], 0
    for row in manifest:
        starts.append((row["shard"], row["name"], at))
        at += row["n_tokens"]
    files = spark.createDataFrame(starts, "shard long, name string, start long")
    if starts:
        files = files.repartitionByRange(len(starts), "shard")
    return mapped(files, _scan(folder), "doc_id long, start long, n_tokens long, ids binary")


def op5_sstable(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's place and checksum, as read back from the shards that this call writes."""
    import public_tokenizers

    folder = shared_path(spark, "sst")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_shards(docs, path or public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_shards(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
