"""Operator 1: token ids in fixed-width bit-packed binary files.

File layout (``.tok``, little-endian):

    magic ``IMTK1``, version byte, id width in bits (uint8), pad byte
    uint32 ids per block, uint32 documents, uint64 ids, uint64 ids of the partition before this file
    documents x (int64 doc_id, uint8 known, uint64 ids)     null doc_ids have known = 0
    (blocks + 1) x uint64 byte offsets from the payload's start
    payload: every block packed at the width, padded to whole bytes

Width is the least that holds the vocabulary: 16 bits for 49,408 ids. Id i lies in block i // block_ids at bit
(i % block_ids) * width, so a reader unpacks any range with numpy after reading two offsets.

Documents are range-partitioned by doc_id; a partition writes files of about ``file_ids`` ids in order. Files have names that
depend on the partition alone and appear by rename, so a task that runs again leaves the same whole files. The driver keeps one
number per partition, the ids before it.

Nulls and ties: null text is empty (end id only). A null doc_id sorts first. Rows that share a doc_id follow each other in
the order of their texts' hashes; repeated rows are kept. An empty table gives no rows and no files. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

_HEAD = struct.Struct("<5sBBxIIQQ")
_MAGIC, _VERSION = b"IMTK1", 1
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n", "<u8")])


def id_width(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids at ``width`` bits each, first id in the lowest bits."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` of a packed block."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, first * (width // 8)).astype("<u4")
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint64)
    bit = (first + np.arange(count, dtype=np.uint64)) * np.uint64(width)
    at, shift = (bit >> np.uint64(3)).astype(np.int64), bit & np.uint64(7)
    word = sum((raw[at + k] << np.uint64(8 * k) for k in range(5)), np.zeros(count, np.uint64))
    return ((word >> shift) & np.uint64((1 << width) - 1)).astype("<u4")


def shard_bytes(docs: list[tuple[int | None, bytes]], width: int, block_ids: int, before: int) -> bytes:
    """One file of documents given as (doc_id, ids as uint32 bytes)."""
    index = np.zeros(len(docs), _DOC)
    for k, (doc_id, ids) in enumerate(docs):
        index[k] = (doc_id or 0, doc_id is not None, len(ids) // 4)
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit in {width} bits")
    blocks = [pack(ids[k:k + block_ids], width) for k in range(0, len(ids), block_ids)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = _HEAD.pack(_MAGIC, _VERSION, width, block_ids, len(docs), len(ids), before)
    return b"".join([head, index.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Random access to a file's bytes."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.block_ids, n_docs, self.n_ids, self.before = _HEAD.unpack_from(data)
        if (magic, version) != (_MAGIC, _VERSION):
            raise ValueError("not a token file")
        at = _HEAD.size
        self.docs = np.frombuffer(data, _DOC, n_docs, at)
        at += self.docs.nbytes
        self.offsets = np.frombuffer(data, "<u8", -(-self.n_ids // self.block_ids) + 1, at)
        self.payload = memoryview(data)[at + self.offsets.nbytes:]
        if len(self.payload) != self.offsets[-1]:
            raise ValueError("a token file is cut short")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start (included) to stop (not included), touching only the blocks that hold them."""
        out = []
        while start < stop:
            block, first = divmod(start, self.block_ids)
            count = min(stop - start, self.block_ids - first)
            data = bytes(self.payload[int(self.offsets[block]):int(self.offsets[block + 1])])
            out.append(unpack(data, self.width, first, count))
            start += count
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, *, space_free: bool = True, end_id: int = 2, block_ids: int = 4096, file_ids: int = 2_000_000, special_as_text: bool = False, cache_bytes: int = 224 << 20) -> list[int]:
    """Encode ``docs`` (doc_id, text) into files under ``path``, in ascending doc_id order; the ids of each partition, in order."""

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = tokens.encoder(tokenizer, space_free, cache_bytes, special_as_text)
        width = id_width(max(enc.vocab_size, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        n_held = n_before = n_files = 0

        def flush() -> None:
            nonlocal held, n_held, n_before, n_files
            common.publish(path, f"part-{part:06d}-{n_files:06d}.tok", shard_bytes(held, width, block_ids, n_before))
            n_before, n_files, held, n_held = n_before + n_held, n_files + 1, [], 0

        for ids, texts in tokens.gathered(batches):
            for doc_id, got in zip(ids, enc.encode(texts), strict=True):
                held.append((doc_id, got + end))
                n_held += len(got) // 4 + 1
                if n_held >= file_ids:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "files": pa.array([n_files], pa.int32()), "ids": pa.array([n_before], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows = common.map_arrow(ordered, write, "part int, files int, ids long").collect()  # one row per task
    counts = dict.fromkeys(range(1 + max((r.part for r in rows), default=-1)), 0)
    counts.update((r.part, r.ids) for r in rows)
    return [counts[k] for k in sorted(counts)]


def read_token_shards(spark, path: str, part_ids: list[int]) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids (binary, little-endian uint32)."""
    before = np.cumsum([0, *part_ids]).tolist()

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_buffer().to_pybytes())
                part = int(name.rsplit("/", 1)[1].split("-")[1])
                stops = np.cumsum(shard.docs["n"]).astype(np.int64)
                starts = stops - shard.docs["n"].astype(np.int64)
                for a in range(0, len(stops), 2000):
                    b = min(a + 2000, len(stops))
                    got = shard.ids(int(starts[a]), int(stops[b - 1]))
                    cut = [got[i - starts[a]:j - starts[a]].tobytes() for i, j in zip(starts[a:b], stops[a:b], strict=True)]
                    known = shard.docs["known"][a:b].astype(bool)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.docs["doc_id"][a:b], pa.int64(), mask=~known),
                        pa.array(starts[a:b] + before[part] + shard.before),
                        pa.array(shard.docs["n"][a:b].astype(np.int64)),
                        pa.array(cut, pa.binary()),
                    ], ["doc_id", "start", "n_tokens", "ids"])

    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not sum(part_ids):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select("path", "content")
    return common.map_arrow(files, read, schema)


def with_crc32(df: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """Adds the unsigned crc32 of a binary column."""
    return df.withColumn(name, F.crc32(F.col(ids)).cast("long"))


