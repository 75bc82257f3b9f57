"""Media columns with content-defined chunks.

A text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64, are the samples
of a mono 8-bit PCM WAV file. A rolling gear hash cuts each file where its highest CUT_BITS
bits are zero, between LEAST and MOST bytes. Chunks are stored once: those of one range of
digests meet, one copy of each stays, and it joins the ordered chunk lists, bucket by bucket
of documents; there the files are put together again, checked against their digests and read back.

Hot chunks: a map task sends a chunk's bytes once, with the set of buckets that use it, and
the store sends them once a bucket. So a chunk that a third of all documents hold is there
once a task and once a bucket at most. Chunks with one destination travel as one compressed
blob, with a dictionary trained from a bounded sample of texts (SAMPLE_ROWS), which has no effect
on results.

Result for each document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
media_bytes, media_sha256, feature, n_chunks. Null text counts as empty; repeated rows
give repeated rows; null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.arrowkit import BYTE_CODE, n_partitions, slices, small_batches, text_bytes

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
LEAST, MOST, CUT_BITS = 1024, 32768, 12
#: Chunks of so many bytes of text are packed together before they are sent.
FLUSH_BYTES, LEVEL = 16 << 20, 9
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 1024, 8192, 112640
DIGEST = 16
GEAR = (BYTE_CODE >> np.uint64(13)).astype(np.uint32)
HEADER = 44


def wav(payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + n) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n & 0xFFFFFFFF) + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a PCM file as written here")
    return media[HEADER:]


def pad(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


def gear_marks(data: np.ndarray) -> np.ndarray:
    """Positions after which a cut may stand: the sum of the last 32 bytes' gear values, each shifted by its distance, ends in zeros."""
    h = GEAR[data]
    step = 1
    while step < 32:
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    # the high bits see all 32 bytes, the low ones only the last few
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def cut_points(marks: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of the chunks of the bytes from begin to end."""
    out, at = [], begin
    while end - at > LEAST:
        i = int(np.searchsorted(marks, at + LEAST))
        at = min(int(marks[i]) if i < len(marks) else end, at + MOST, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def chunked(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """Row, media file and chunks of each document of a slice."""
    data, at = text_bytes(batch.column(1))
    whole = data.tobytes()
    files = [wav(pad(whole[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    joined = b"".join(files)
    marks = gear_marks(np.frombuffer(joined, np.uint8))
    begin = 0
    for row, media in enumerate(files):
        end, parts = begin + len(media), []
        for cut in cut_points(marks, begin, end):
            parts.append(joined[begin:cut])
            begin = cut
        yield row, media, parts


def bucket_of(doc_id: int | None, media: bytes, n: int) -> int:
    """Where a document is put together again; those without doc_id are spread by their bytes."""
    return ((zlib.crc32(media) if doc_id is None else doc_id) * 0x9E3779B97F4A7C15 % 2**64 >> 33) % n


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def feature(payload: bytes) -> str:
    """Sum, largest sample, sum of absolute steps and number of steps through the middle value."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16)
    high = x >= 128
    return f"sum={int(x.sum(dtype=np.int64))};max={int(x.max())};rough={int(np.abs(np.diff(x)).sum(dtype=np.int64))};cross={int((high[1:] != high[:-1]).sum())}"


def media_features(docs: DataFrame) -> DataFrame:
    """Stores, chunks, deduplicates, puts together again and reads back every document; see above."""
    import zstandard

    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    n_buckets = 4 * n_partitions(spark)
    sample = [r[0].encode() for r in docs.where("text is not null").select(F.substring("text", 1, SAMPLE_CHARS)).limit(SAMPLE_ROWS).collect()]
    words = b""
    if sum(map(len, sample)) > 16 * 1024:
        try:
            words = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample).as_bytes()
        except zstandard.ZstdError:
            words = b""

    def known():
        return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}

    def packed(digests: list[bytes], parts: list[bytes | None], uses: list[list[int]], squeeze) -> bytes:
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([pa.array(digests, pa.binary()), pa.array(parts, pa.large_binary()), pa.array(uses, pa.list_(pa.int32()))], names=["digest", "part", "uses"])
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        return squeeze(sink.getvalue().to_pybytes())

    def unpacked(data: bytes, expand) -> Iterator[tuple[bytes, bytes | None, list[int]]]:
        held = pa.ipc.open_stream(expand(data)).read_all()
        return zip(*(held.column(c).to_pylist() for c in ("digest", "part", "uses")))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL, **known()).compress
        sent: set[bytes] = set()
        for batch in slices(batches, "text", FLUSH_BYTES):
            ids, found = batch.column(0).to_pylist(), {}
            for row, media, parts in chunked(batch):
                bucket = bucket_of(ids[row], media, n_buckets)
                for part in parts:
                    found.setdefault(digest(part), (part, set()))[1].add(bucket)
            by: dict[int, list[bytes]] = {}
            for d in found:
                by.setdefault(int.from_bytes(d[:4], "little") % n_buckets, []).append(d)
            data = [packed(ds, [None if d in sent else found[d][0] for d in ds], [sorted(found[d][1]) for d in ds], squeeze) for ds in by.values()]
            sent.update(found)
            if len(sent) > 1_000_000:
                sent.clear()
            yield pa.record_batch([pa.array(list(by), pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    def store(key: tuple, rows: pa.Table) -> pa.Table:
        """Keeps one copy of each chunk and sends it, once a bucket, to the documents that use it."""
        expand, squeeze = zstandard.ZstdDecompressor(**known()).decompress, zstandard.ZstdCompressor(level=LEVEL, **known()).compress
        held: dict[bytes, bytes] = {}
        by: dict[int, set[bytes]] = {}
        for x in rows.column("data"):
            for d, part, uses in unpacked(x.as_py(), expand):
                if part is not None:
                    held[d] = part
                for bucket in uses:
                    by.setdefault(bucket, set()).add(d)
        data = [packed(sorted(ds), [held[d] for d in sorted(ds)], [[]] * len(ds), squeeze) for ds in by.values()]
        return pa.table([pa.array(list(by), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, rows = batch.column(0).to_pylist(), []
            _, at = text_bytes(batch.column(1))
            for row, media, parts in chunked(batch):
                rows.append((bucket_of(ids[row], media, n_buckets), int(at[row + 1] - at[row]), hashlib.sha256(media).digest(), b"".join(map(digest, parts))))
            bucket, n, sha, digests = zip(*rows)
            yield pa.record_batch([batch.column(0), pa.array(bucket, pa.int32()), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(digests, pa.binary())], names=["doc_id", "bucket", "n_bytes", "sha", "digests"])

    def rebuild(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor(**known()).decompress
        held = {d: part for x in right.column("data") for d, part, _ in unpacked(x.as_py(), expand)}
        rows = []
        for doc, n, sha, digests in zip(*(left.column(c).to_pylist() for c in ("doc_id", "n_bytes", "sha", "digests"))):
            order = [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
            media = b"".join(held[d] for d in order)
            if hashlib.sha256(media).digest() != sha:
                raise ValueError(f"document {doc}: the stored file differs from what was written")
            payload = samples(media)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha.hex(), feature(payload), len(order)))
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.table({k: pa.array(c, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, c in zip(names, columns)})

    sent = docs.mapInArrow(chunks, "part int, data binary").groupBy("part").applyInArrow(store, "bucket int, data binary")
    ordered = docs.mapInArrow(lists, "doc_id long, bucket int, n_bytes long, sha binary, digests binary")
    return ordered.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(rebuild, SCHEMA)
