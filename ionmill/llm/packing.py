"""Operator 10: packing documents into sequences, bulk-synchronous best-fit.

Each superstep takes all documents of one length, longest first, and all gaps, both in order. A sweep gives every document its
successor, the least gap that holds it; where several want the same gap, the lower rank takes it and the rest go on to the next gap;
when no gap is left, new sequences open. Then the gaps are updated and the next superstep begins.

Documents of one length cannot be told apart, so a superstep runs on runs of ranks: gaps of one size that were opened or filled together are one
(first sequence, count) run, and a match of runs is one move (length, first rank, count, first sequence, offset). A superstep splits one run and
opens at most 2 + capacity / length, and every other move replaces a run by one of smaller gap: runs and moves are bounded by the capacity
alone, whatever the number of documents. So the sweeps need no cluster: they run on the driver over at most ``capacity`` counts, and
the work that grows with the documents (token ids, ranks, placing each document by its move) is distributed.

Ranks are dealt without a global sort: tasks number their pieces within a length as they write them, and one prefix sum over
(length, task) counts makes the numbers global. A length that a third of all rows share is spread over all tasks.

Only documents longer than the capacity are cut; the first piece takes the remainder. Rows: one per piece. Null text is empty
(end id only). Repeated rows and null doc_ids are packed like others. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, place long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    whole = -(-n // capacity) - 1 if n else 0
    first = n - whole * capacity
    return [(0, first), *((first + k * capacity, capacity) for k in range(whole))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, space_free: bool = False, cache_bytes: int = 224 << 20) -> DataFrame:
    """PIECES: every document's pieces, with their place among the pieces of that length in the same task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc, end = tokens.encoder(tokenizer, space_free, cache_bytes), np.array([end_id], "<u4").tobytes()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        for ids, texts in tokens.gathered(batches, min(6_000_000, cache_bytes // 16)):
            rows = []
            for doc_id, got in zip(ids, enc.encode(texts), strict=True):
                got += end
                for k, (start, length) in enumerate(cut(len(got) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(got[4 * start:4 * (start + length)]), task, int(seen[length])))
                    seen[length] += 1
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return common.map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Moves (length, first rank, count, first sequence, offset) in order of length and rank, and the number of sequences."""
    gaps: dict[int, deque[tuple[int, int]]] = {}
    sizes: list[int] = []  # of the gaps there are, ascending
    moves: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = deque()
                bisect.insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit")
        rank, n = 0, counts[length]
        while rank < n and (at := bisect.bisect_left(sizes, length)) < len(sizes):
            gap = sizes[at]
            first, count = gaps[gap].popleft()
            take = min(count, n - rank)
            moves.append((length, rank, take, first, capacity - gap))
            if take < count:
                gaps[gap].appendleft((first + take, count - take))
            elif not gaps[gap]:
                del gaps[gap], sizes[at]
            leave(gap - length, first, take)
            rank += take
        if rank < n:
            each = capacity // length
            fresh = width = -(-(n - rank) // each)
            for layer in range(each):
                take = min(width, n - rank)
                if take:
                    moves.append((length, rank, take, opened, layer * length))
                    rank += take
                if take < width:
                    leave(capacity - layer * length, opened + take, width - take)
                    width = take
            if width:
                leave(capacity - each * length, opened, width)
            opened += fresh
    moves.sort()
    return np.array(moves, np.int64).reshape(-1, 5), opened


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, space_free: bool = False, cache_bytes: int = 224 << 20) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    common.slim(spark)
    pieces = common.materialize(token_pieces(docs, tokenizer, capacity, end_id, space_free, cache_bytes), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    moves, _ = plan(counts, capacity)
    held = spark.sparkContext.broadcast(moves)  # bounded by the capacity
    ranked = pieces.join(per_task.withColumn("before", before).drop("n"), ["length", "task"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("place") + F.col("before")).alias("rank"))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = held.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            sequence = table[at, 3] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return common.map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
