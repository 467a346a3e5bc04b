"""Operator 9: media columns. FLAC streams in a binary column, and their samples as seekable blocks of PCM."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .common import bounded_batches, text_or_empty, written

#: Payloads are multiples of so many bytes, and their last so many have a checksum.
UNIT = 64


def padded(text: str) -> bytes:
    b = text.encode("utf-8", "surrogatepass")
    return b + bytes(-len(b) % UNIT if b else UNIT)


def _some(items: list, size, most: int = 4_000_000):
    """Runs of items of a few million in size together, so that numpy's arrays stay small."""
    run, total = [], 0
    for x in items:
        run.append(x)
        total += size(x)
        if total >= most:
            yield run
            run, total = [], 0
    if run:
        yield run


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written (doc_id, n_bytes, media): each text, padded with zero bytes to a multiple of 64, as a FLAC stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in _some(list(zip(pdf["doc_id"], pdf["text"], strict=True)), lambda x: len(x[1])):
                payloads = [padded(t) for _, t in some]
                yield pd.DataFrame({"doc_id": [i for i, _ in some], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for _, t in some], "media": flac.encode(payloads)})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInPandas(run, "doc_id string, n_bytes long, media binary")
    return written(found.withColumn("doc_id", F.col("doc_id").cast("long")), "media")


def _blocks(batches: Iterator[pd.DataFrame], keys: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """The blocks of every stream of the column media, one stream after another, with the keys of its row."""
    columns = [*keys, "block", "sample_offset", "n_samples", "pcm"]
    for pdf in batches:
        for some in _some(list(pdf[[*keys, "media"]].itertuples(index=False)), lambda x: len(x.media)):
            rows = []
            for own, blocks in zip(some, flac.decode([x.media for x in some]), strict=True):
                rows += [(*own[: len(keys)], n, s, len(x), x.astype(np.int8).tobytes()) for n, (s, x) in enumerate(blocks)]
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def pcm_blocks(media: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, sample_offset, n_samples, pcm): the blocks of every stream, decoded and verified, by sample offset.

    A reader who wants sample s of a stream needs the one block with sample_offset <= s < sample_offset + n_samples. A
    stream that isn't FLAC or whose checksums don't hold stops the job with flac.Broken; a null stream gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _blocks(batches, keys)

    bounded_batches(media.sparkSession)
    kept = media.select(*[F.col(k).cast("string").alias(k) for k in keys], "media").where("media is not null")
    found = kept.mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", block int, sample_offset long, n_samples int, pcm binary")
    return found.select(*[F.col(k).cast(media.schema[k].dataType).alias(k) for k in keys], "block", "sample_offset", "n_samples", "pcm")


def between(blocks: DataFrame, first: int, end: int) -> DataFrame:
    """The rows of blocks that hold samples from `first` to before `end`, with these samples alone: a seek, by offsets."""
    held = blocks.where((F.col("sample_offset") < end) & (F.col("sample_offset") + F.col("n_samples") > first))
    skip = F.greatest(F.lit(first) - F.col("sample_offset"), F.lit(0)).cast("int")
    n = (F.least(F.lit(end), F.col("sample_offset") + F.col("n_samples")) - F.col("sample_offset") - skip).cast("int")
    held = held.withColumn("_skip", skip).withColumn("_n", n)
    held = held.withColumn("pcm", F.substring("pcm", F.col("_skip") + 1, F.col("_n")))
    return held.withColumn("sample_offset", F.col("sample_offset") + F.col("_skip")).withColumn("n_samples", F.col("_n")).drop("_skip", "_n")


class _Sums:
    """What the blocks of one stream amount to, as they come."""

    def __init__(self, own: tuple):
        self.own, self.hash, self.tail = own, hashlib.sha256(), b""
        self.n = self.square = self.crossings = self.blocks = self.low = self.high = 0
        self.sign = None

    def add(self, offset: int, pcm: bytes) -> None:
        if offset != self.n:
            raise flac.Broken(f"a block starts at sample {offset}, not at {self.n}")
        x = np.frombuffer(pcm, np.int8)
        payload = flac.BYTE[x.view(np.uint8)].tobytes()
        self.hash.update(payload)
        self.tail = (self.tail + payload[-UNIT:])[-UNIT:]
        wide, sign = x.astype(np.int32), np.signbit(x)
        low, high = int(wide.min()), int(wide.max())
        self.low, self.high = (min(self.low, low), max(self.high, high)) if self.n else (low, high)
        self.crossings += int(np.count_nonzero(sign[1:] != sign[:-1])) + int(self.n > 0 and bool(sign[0]) != self.sign)
        self.sign, self.n = bool(sign[-1]), self.n + len(x)
        self.square += int((wide * wide).sum(dtype=np.int64))
        self.blocks += 1

    def row(self) -> tuple:
        feature = f"square={self.square // self.n};crossings={self.crossings};low={self.low};high={self.high};blocks={self.blocks}"
        doc, n_bytes, media_bytes, media_sha256 = self.own
        return doc, n_bytes, self.n, self.hash.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha256, feature


def media_features(media: DataFrame) -> DataFrame:
    """What the stored streams hold: payload, checksums, and a feature of the samples (mean square, zero crossings, peaks).

    The streams are read as the blocks of pcm_blocks(), in the same Python worker, and added up block by block; each must
    start where the one before ends. Equal texts give equal values. Null texts count as empty,
    and an empty text is 64 zero bytes; rows with a null or repeated identifier are stored each; an empty table gives no
    rows; other columns are not read.
    """
    keys = ("doc_id", "n_bytes", "media_bytes", "media_sha256")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: _Sums | None = None
        for pdf in _blocks(batches, keys):
            rows = []
            for doc, n_bytes, media_bytes, digest, block, offset, _, pcm in pdf.itertuples(index=False):
                if block == 0:
                    if sums:
                        rows.append(sums.row())
                    sums = _Sums((doc, n_bytes, media_bytes, digest))
                sums.add(offset, pcm)
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if sums:
            yield pd.DataFrame([sums.row()], columns=names)

    own = media.select(F.col("doc_id").cast("string").alias("doc_id"), "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    bounded_batches(media.sparkSession)
    found = own.where("media is not null").mapInPandas(run, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
