"""Operator 5: token ids in sorted-string-table shards.

A shard holds documents in ascending order of identifier. File layout, all integers little-endian unless said otherwise:

    data blocks, one after another
    index       for each block: key length u32, last key, block offset u64, block length u32, entries u32
    filter      number of hashes u32, then the bits of a Bloom filter over the keys
    footer      offset and length of index and of filter (4 x u64), documents u64, tokens u64, bytes an id u32, magic 8 bytes

An entry in a block is: shared key length, own key length, tokens (varints), the key's own bytes, the ids. Keys are
prefix-compressed against the entry before; each block starts anew. A key is 01 and the identifier as a big-endian
integer with its sign bit turned, so that bytes sort as integers do; a null identifier is the key 00, before all others.

Defined results: a null text counts as empty; every document gets the end id, so none has 0 tokens; rows of the same
identifier stay, one after another, in the order of their ids' bytes; an empty table gives no file and no row; columns
other than the identifier and the text are not read. A document's ids must fit in memory; nothing else has to.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, new_folder, partitions, text_or_empty, written
from .wordbpe import crc_of_ids, encoded_batches, encoder

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<4QQQI8s")
BLOCK = 1 << 16
BITS_A_KEY = 10
HASHES = 7


def key_of(identifier: int | None) -> bytes:
    return b"\0" if identifier is None else b"\1" + struct.pack(">Q", (identifier + (1 << 63)) & (1 << 64) - 1)


def identifier_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _filter_hashes(key: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    return h & (1 << 64) - 1, h >> 64 | 1


class ShardWriter:
    """Writes one shard to a binary stream; entries come in order of key."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.documents = self.tokens = 0
        self.block, self.entries, self.last = bytearray(), 0, b""
        self.index: list[bytes] = []
        self.hashes: list[tuple[int, int]] = []

    def add(self, key: bytes, ids: bytes) -> None:
        if self.documents and key < self.previous:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        n = len(ids) // self.width
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(n) + key[shared:] + ids
        self.entries, self.last, self.previous = self.entries + 1, key, key
        self.documents, self.tokens = self.documents + 1, self.tokens + n
        self.hashes.append(_filter_hashes(key))
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            self.out.write(bytes(self.block))
            self.index.append(struct.pack("<I", len(self.last)) + self.last + struct.pack("<QII", self.at, len(self.block), self.entries))
            self.at += len(self.block)
            self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, self.documents * BITS_A_KEY)
        field = np.zeros((bits + 7) // 8, np.uint8)
        if self.hashes:
            h = np.array(self.hashes, np.uint64)
            for i in range(HASHES):
                at = (h[:, 0] + np.uint64(i) * h[:, 1]) % np.uint64(len(field) * 8)
                np.bitwise_or.at(field, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        bloom = struct.pack("<I", HASHES) + field.tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.documents, self.tokens, self.width, MAGIC))


class ShardReader:
    """Reads a shard from a seekable stream (pyarrow's or Python's) of `size` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        foot = self._read(size - FOOTER.size, FOOTER.size)
        at, n, bloom_at, bloom_n, self.documents, self.tokens, self.width, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.dtype = np.dtype(f"<u{self.width}")
        index, self.blocks, self.lasts, i = self._read(at, n), [], [], 0
        while i < n:
            (k,) = struct.unpack_from("<I", index, i)
            self.lasts.append(index[i + 4 : i + 4 + k])
            self.blocks.append(struct.unpack_from("<QII", index, i + 4 + k))
            i += 20 + k
        bloom = self._read(bloom_at, bloom_n)
        self.hashes, self.field = struct.unpack_from("<I", bloom)[0], bloom[4:]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _entries(self, number: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, length, n = self.blocks[number]
        b, i, key = self._read(at, length), 0, b""
        for _ in range(n):
            shared, i = _read_varint(b, i)
            own, i = _read_varint(b, i)
            count, i = _read_varint(b, i)
            key = key[:shared] + b[i : i + own]
            i += own
            yield key, np.frombuffer(b, self.dtype, count, i)
            i += count * self.width

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for number in range(len(self.blocks)):
            for key, ids in self._entries(number):
                yield identifier_of(key), ids

    def may_hold(self, identifier: int | None) -> bool:
        a, b = _filter_hashes(key_of(identifier))
        bits = len(self.field) * 8
        at = [((a + i * b) & (1 << 64) - 1) % bits for i in range(self.hashes)]
        return all(self.field[x >> 3] >> (x & 7) & 1 for x in at)

    def lookup(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier: a filter test, a binary search of the index, then its blocks."""
        from bisect import bisect_left

        key, found = key_of(identifier), []
        if not self.may_hold(identifier):
            return found
        for number in range(bisect_left(self.lasts, key), len(self.blocks)):
            for k, ids in self._entries(number):
                if k == key:
                    found.append(ids)
            if self.lasts[number] > key:
                break
        return found


def open_shard(path: str) -> ShardReader:
    fs, place = filesystem(path)
    return ShardReader(fs.open_input_file(place), fs.get_file_info(place).size)


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs into shards in folder; return the manifest (shard, path, documents, tokens), written and read again.

    Shards follow one another in order of identifier. A task writes its shard under a name of its own, and only the
    manifest's rows count, so a task that is run again leaves at most a file that nothing refers to.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        fs, place = filesystem(folder)
        path, out, writer = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex}.sst", None, None
        same: tuple = ()
        held: list[bytes] = []

        def put() -> None:
            for ids in sorted(held):
                writer.add(same[0], ids)
            held.clear()

        for pdf in batches:
            names = pdf["key"].array
            for i, ids in encoded_batches(vocabulary, pdf["text"].tolist()):
                if writer is None:
                    fs.create_dir(place, recursive=True)
                    out = fs.open_output_stream(f"{place}/{path.rpartition('/')[2]}")
                    writer = ShardWriter(out, enc.width)
                key = key_of(None if pd.isna(names[i]) else int(names[i]))
                if (key,) != same:
                    put()
                    same = (key,)
                held.append(ids + end)
        if writer is not None:
            put()
            writer.close()
            out.close()
            yield pd.DataFrame({"shard": [shard], "path": [path], "documents": [writer.documents], "tokens": [writer.tokens]})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), text_or_empty(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
    # the identifier goes as text, as a column of integers with nulls would come as floating point
    rows = rows.select(F.col("key").cast("string").alias("key"), "text")
    return written(rows.mapInPandas(write, "shard int, path string, documents long, tokens long"), "id-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """The documents of the shards, from their files: doc_id, start (tokens of all documents before), n_tokens, ids_crc32.

    The manifest has one row for each shard; its running total is taken on the driver.
    """
    spark, total, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("shard").collect():
        rows.append((r.path, total))
        total += r.tokens

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"], strict=True):
                out: list[tuple] = []
                for identifier, ids in open_shard(path).scan():
                    out.append((identifier, start, len(ids), crc_of_ids(ids)))
                    start += len(ids)
                    if len(out) == 50_000:
                        yield _frame(out)
                        out = []
                if out:
                    yield _frame(out)

    shards = spark.createDataFrame(rows, "path string, start long")
    return shards.repartition(max(1, len(rows)), "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return pdf.astype({"doc_id": "Int64"})


def token_shards(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write docs as shards in the shared folder and return what read_shards() finds in the files."""
    return read_shards(write_shards(docs, vocabulary, end_id, new_folder(docs.sparkSession, "id-shards")))
