"""Cost-balanced packing of documents into training sequences.

A sequence's cost is the sum over its pieces of LINEAR * n + QUADRATIC * n * n: attention stays inside a piece.
Documents are dealt in blocks of about BLOCK_TOKENS tokens as a task streams through its partition, so no shuffle is
needed and memory is bounded. In a block of T tokens there are T // capacity full sequences, and one sequence for each
power of two in T % capacity: together they hold exactly T tokens, so nothing is padded. Pieces are assigned in
descending cost to the lowest-cost sequence with room for the whole piece; where none has it, the piece is cut and the
lowest-cost sequence with any room takes what it can.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from granary.llm.common import slices
from granary.llm.tokens import encode

BLOCK_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def costs(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


def pack_block(lengths: list[int], capacity: int = 1024) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs one block. Returns (document, start, length, sequence, offset) rows and the number of sequences.

    Documents of length 0 get no piece. Equal costs go by document number, equal sequences by their number.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    total = sum(lengths)
    rest = total % capacity
    sizes = [capacity] * (total // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    room, used, cost = list(sizes), [0] * len(sizes), [0.0] * len(sizes)
    rooms, by_cost = np.array(room, dtype=np.int64), np.array(cost)  # the same for scans
    rows: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, n: int, seq: int) -> None:
        rows.append((doc, start, n, seq, used[seq]))
        used[seq] += n
        room[seq] -= n
        cost[seq] += costs(n)
        rooms[seq], by_cost[seq] = room[seq], cost[seq]

    seq, items = 0, []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):  # a full piece costs most of all: it takes an empty sequence
            put(doc, k * capacity, capacity, seq)
            seq += 1
        if n % capacity:
            items.append((n % capacity, doc, whole * capacity))
    items.sort(key=lambda x: (-x[0], x[1]))
    # Pieces get shorter, so a sequence without room for one waits for the first piece that it can hold. Entries whose cost
    # or room is no longer the sequence's own are stale.
    heap: list[tuple[float, int]] = []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k, r in enumerate(room):
        waiting[r].append(k)
    longest = capacity + 1
    for n, doc, start in items:
        for r in range(n, longest):
            for k in waiting[r]:
                if room[k] == r:
                    heappush(heap, (cost[k], k))
        longest = n

        def settle(k: int, least: int = n) -> None:
            if room[k] >= least:
                heappush(heap, (cost[k], k))
            else:
                waiting[room[k]].append(k)

        while heap and (cost[heap[0][1]] != heap[0][0] or room[heap[0][1]] < n):
            heappop(heap)
        if heap:
            at = heappop(heap)[1]
            put(doc, start, n, at)
            settle(at)
            continue
        while n:  # cut: each part but the last fills a sequence, so there are at most as many cuts as sequences
            fits = rooms >= n
            at = int(np.where(fits if fits.any() else rooms > 0, by_cost, np.inf).argmin())
            part = min(n, room[at])
            put(doc, start, part, at)
            settle(at)
            n, start = n - part, start + part
    return rows, len(sizes)


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 1024, block_tokens: int = BLOCK_TOKENS, with_ids: bool = False) -> DataFrame:
    """Tokenizes each text, appends end_id and packs all documents into sequences of at most `capacity` tokens.

    Returns a row for each piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    with_ids the ids. Null and empty texts hold just end_id; null ids and repeated rows are packed like any others;
    a very long text is cut over many sequences; an empty table gives no rows; other columns are not read.
    sequence_id is the partition's number and a count in it, so it is unique but has gaps.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)] + [T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))] + ([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        first, id_type = TaskContext.get().partitionId() << 40, None
        names, ids, held = [], [], 0

        def flush():
            nonlocal first, names, ids, held
            rows, n = pack_block([len(x) // 4 for x in ids], capacity)
            doc, start, length, seq, offset = (list(c) for c in zip(*rows, strict=True))
            parts = [ids[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc, start, length, strict=True)]
            columns = [pa.array([names[d] for d in doc], type=id_type)] + [pa.array(c, type=pa.int64()) for c in (start, length, [zlib.crc32(p) for p in parts], [len(ids[d]) // 4 for d in doc], [first + s for s in seq], offset)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in parts], type=pa.list_(pa.int64())))
            first, names, ids, held = first + n, [], [], 0
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for part in slices(batches, "__text", 1 << 14, 8 << 20):
            id_type = part.column("__id").type
            names += part.column("__id").to_pylist()
            for x in encode(tokenizer_path, part.column("__text").to_pylist()):
                ids.append(x.tobytes() + end)
                held += len(x) + 1
            if held >= block_tokens:
                yield flush()
        if names:
            yield flush()

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)
