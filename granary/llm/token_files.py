"""Token ids in files of patched frame-of-reference blocks.

A block holds up to 128 ids of one document: the smallest id, a bit width chosen so that PERCENTILE of the differences
from it fit, the differences packed at that width, and a list of exceptions (position, whole difference) for the rest.

    block    = smallest u32 | width u8 | exceptions u8 | packed differences | positions u8[] | differences u32[]

A file is a Parquet data set; each row is a segment of consecutive documents: their ids and token counts, the blocks one
after another, and the index of block starts. Rows are in ascending id order by (part, segment), so any document's
tokens are found by its segment, its block numbers and their starts. All integers are little-endian.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from granary.llm.common import scratch_dir, slices
from granary.llm.tokens import encode

BLOCK, HEAD = 128, 6
PERCENTILE = 0.9
SEGMENT_BYTES = 1 << 20


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _counts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each document, and ids in each block."""
    blocks = -(-lengths // BLOCK)
    counts = np.full(int(blocks.sum()), BLOCK, dtype=np.int64)
    last = np.cumsum(blocks)[blocks > 0] - 1
    counts[last] = (lengths[blocks > 0] - 1) % BLOCK + 1
    return blocks, counts


def encode_blocks(ids: list[np.ndarray], percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs documents. Returns the bytes, the start of each block and one end more, and each document's block count."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    blocks, counts = _counts(lengths)
    n = len(counts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), blocks
    valid = np.arange(BLOCK) < counts[:, None]
    grid = np.full((n, BLOCK), 0xFFFFFFFF, dtype=np.uint32)
    grid[valid] = np.concatenate(ids)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    part = np.flatnonzero(counts < BLOCK)
    diff[part] *= valid[part]
    small = int(diff.max()) < 1 << 16
    diff = diff.astype(np.uint16) if small else diff
    full = int(np.ceil(percentile * BLOCK)) - 1
    bound = np.partition(diff, full, axis=1)[:, full]
    rank = np.clip((BLOCK - counts[part]) + np.ceil(percentile * counts[part]).astype(np.int64) - 1, 0, BLOCK - 1)  # padding sorts first
    bound[part] = np.sort(diff[part], axis=1)[np.arange(len(part)), rank]
    width = _bit_length(bound)
    over = diff > ((1 << width) - 1).astype(diff.dtype)[:, None]
    outs = over.sum(axis=1)
    packed = -(-counts * width // 8)
    start = np.concatenate([[0], np.cumsum(HEAD + packed + 5 * outs)])
    out = np.zeros(int(start[-1]), dtype=np.uint8)
    at = start[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[at + 4], out[at + 5] = width, outs
    diff_low = np.where(over, diff.dtype.type(0), diff)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(diff_low[rows].view(np.uint8).reshape(len(rows), BLOCK, diff.itemsize), axis=2, bitorder="little")[:, :, :w]
            data = np.packbits(bits.reshape(len(rows), BLOCK * w), axis=1, bitorder="little")
            cols = np.arange(data.shape[1])
            kept = cols < packed[rows][:, None]
            to = at[rows][:, None] + HEAD + cols
            if kept.all():
                out[to] = data
            else:
                out[to[kept]] = data[kept]
    row, pos = np.nonzero(over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(outs) - outs, outs)
    tail = at[row] + HEAD + packed[row]
    out[tail + nth] = pos
    out[(tail + outs[row] + 4 * nth)[:, None] + np.arange(4)] = diff[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, start, blocks


def decode_blocks(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of all documents of a segment, one after another. start: each block's; lengths: ids of each document."""
    _, counts = _counts(lengths.astype(np.int64))
    n = len(counts)
    if not n:
        return np.zeros(0, dtype="<u4")
    at = start[:n].astype(np.int64)
    low = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").reshape(n)
    width, outs = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    packed = -(-counts * width // 8)
    values = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            cols = np.arange(BLOCK * w // 8)
            kept = cols < packed[rows][:, None]
            got = np.zeros((len(rows), len(cols) + 4), dtype=np.uint8)  # a value of 25 bits or less lies in 4 bytes
            if kept.all():
                got[:, : len(cols)] = data[at[rows][:, None] + HEAD + cols]
            else:
                got[:, : len(cols)][kept] = data[(at[rows][:, None] + HEAD + cols)[kept]]
            if w <= 25:
                bit = np.arange(BLOCK) * w
                byte, shift = bit >> 3, (bit & 7).astype(np.uint32)
                value = got[:, byte].astype(np.uint32)
                for k in range(1, 3 if w <= 17 else 4):
                    value |= got[:, byte + k].astype(np.uint32) << np.uint32(8 * k)
                values[rows] = (value >> shift) & np.uint32((1 << int(w)) - 1)
            else:
                bits = np.zeros((len(rows) * BLOCK, 32), dtype=np.uint8)
                bits[:, :w] = np.unpackbits(got[:, : len(cols)], axis=1, bitorder="little").reshape(-1, w)
                values[rows] = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(len(rows), BLOCK)
    row = np.repeat(np.arange(n), outs)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(outs) - outs, outs)
    tail = at[row] + HEAD + packed[row]
    values[row, data[tail + nth]] = np.ascontiguousarray(data[(tail + outs[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    values += low[:, None]
    return values[np.arange(BLOCK) < counts[:, None]].astype("<u4", copy=False)


FILE_SCHEMA = "part int, segment int, doc_ids array<long>, doc_tokens array<int>, n_tokens long, block_starts array<int>, blocks binary"


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Tokenizes each text, appends end_id and writes all ids to `path` in ascending order of the integer id column.

    Texts are encoded and packed where they are read; only the packed blocks are exchanged, once, by boundaries taken
    from the id column. Rows of one id (and of a null id; these come first) may be dealt to several parts, in any
    order. Null and empty texts hold just end_id; an empty table gives an empty data set; other columns are not read.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [k / parts for k in range(1, parts)] or [0.5]
    stats = df.agg(F.percentile_approx(F.col(id_col).cast("long"), share, 10 * parts + 1000).alias("q"), F.count("*").alias("n"), F.count(id_col).alias("known")).first()
    null_parts = round(parts * (stats["n"] - stats["known"]) / stats["n"]) if stats["n"] else 0
    bounds = np.array(stats["q"] or [], dtype=np.int64)
    n_parts = len(bounds) + 1 + null_parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, turn = np.array([end_id], dtype="<u4"), TaskContext.get().partitionId()
        for part in slices(batches, "__text", 1 << 14, 8 << 20):
            keys = part.column("__id")
            ids = [np.concatenate([x, end]) for x in encode(tokenizer_path, part.column("__text").to_pylist())]
            data, start, blocks = encode_blocks(ids)
            ends = np.cumsum(blocks)
            payload = [data[start[e - b] : start[e]].tobytes() for b, e in zip(blocks, ends, strict=True)]
            starts = [(start[e - b : e] - start[e - b]).astype(np.int32) for b, e in zip(blocks, ends, strict=True)]
            null, key = np.asarray(keys.is_null()), np.asarray(keys.fill_null(0))
            below, upto = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
            dealt = turn + np.arange(len(key))  # ties go by turns to all parts that may hold them
            to = np.where(null, dealt % max(null_parts, 1), null_parts + below + dealt % (upto - below + 1))
            turn += len(key)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), keys, pa.array([len(x) for x in ids], pa.int32()), pa.array(starts, pa.list_(pa.int32())), pa.array(payload, pa.binary())], names=["to", "id", "n", "starts", "blocks"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment = TaskContext.get().partitionId(), 0
        keys, counts, starts, blocks, size = [], [], [], [], 0

        def flush():
            row = {"part": number, "segment": segment, "doc_ids": keys, "doc_tokens": counts, "n_tokens": sum(counts), "block_starts": np.concatenate(starts), "blocks": b"".join(blocks)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("block_starts", pa.list_(pa.int32())), ("blocks", pa.binary())])
        for batch in batches:
            for key, n, s, b in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "starts", "blocks")), strict=True):
                if blocks and size + len(b) > SEGMENT_BYTES:
                    yield flush()
                    segment, keys, counts, starts, blocks, size = segment + 1, [], [], [], [], 0
                keys.append(key)
                counts.append(n)
                starts.append(np.asarray(s, dtype=np.int32) + np.int32(size))
                blocks.append(b)
                size += len(b)
        if blocks:
            yield flush()

    (
        df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
        .mapInArrow(pack, "to int, id long, n int, starts array<int>, blocks binary")
        .repartitionById(n_parts, F.col("to"))
        .sortWithinPartitions("id")
        .mapInArrow(assemble, FILE_SCHEMA)
        .write.option("compression", "none")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with with_ids the ids.

    Starts are sums on two levels: over the parts, of which there are as many as tasks wrote the files, and over the
    segments of one part. No task sorts all segments. Repeated and null ids have a row for each of their documents; an
    empty data set gives no rows.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    index = sizes.withColumn("within", within).join(parts.select("part", "before"), "part").select("part", "segment", (F.col("before") + F.col("within")).alias("__first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("part", "segment", "doc_ids", "doc_tokens", "block_starts", "blocks")}
                lengths = np.asarray(row["doc_tokens"].values, dtype=np.int64)
                ids = decode_blocks(np.frombuffer(row["blocks"].as_py(), np.uint8), np.asarray(row["block_starts"].values), lengths)
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e] for n, e in zip(lengths, ends, strict=True)]
                columns = [pa.array([row[c].as_py()] * len(parts), pa.int32()) for c in ("part", "segment")]
                columns += [row["doc_ids"].values, pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))] * with_ids, names=["part", "segment", "doc_id", "local", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    docs = files.mapInArrow(run, "part int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return docs.join(index, ["part", "segment"]).select("doc_id", (F.col("__first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(df: DataFrame, tokenizer_path: str, end_id: int = 1, **columns) -> DataFrame:
    """Writes the files to the shared scratch folder and reads them back."""
    path = f"{scratch_dir(df.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(df, path, tokenizer_path, end_id, **columns)
    return read_token_files(df.sparkSession, path)
