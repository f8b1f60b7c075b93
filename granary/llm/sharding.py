"""Sharding by histogram sort: shards of nearly equal bytes in the order of a key.

The key is (hash of the text, hash of the id, row number), so equal texts stand together and a group of copies too
large for a shard can still be split. The rows' keys and sizes are written once. In each round, every task sums exact
bytes between the probes of each open splitter over its rows, the sums are added across tasks, and a splitter either
meets its tolerance at a probe or its interval shrinks to the one that holds its target; when an interval holds a
single value, probing goes on in the next part of the key. Probes fall on values that exist, so splitters prefer the
edges of groups. With the splitters known, rows are exchanged once, straight to their place.

A shard is exchanged as several consecutive parts, so tasks don't grow with the shards.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from granary.llm.common import written

PROBES = 256
TOLERANCE, PART_TOLERANCE = 0.005, 0.1
KEY = ("h1", "h2", "h3")
TOP = 1 << 62
MOST_PARTS = 4096


@dataclass(frozen=True)
class Interval:
    """Keys that start with `prefix` and go on with a value from lo to hi."""

    prefix: tuple[int, ...]
    lo: int
    hi: int

    @property
    def step(self) -> int:
        return -(-(self.hi - self.lo + 1) // PROBES)


def locate(keys: list[np.ndarray], splitters: list[tuple[int, int, int]]) -> np.ndarray:
    """How many of the sorted splitters are at or below each key."""
    first = np.array([s[0] for s in splitters], dtype=np.int64)
    if len(keys) == 1:
        return np.searchsorted(first, keys[0], "right")
    out, right = np.searchsorted(first, keys[0], "left"), np.searchsorted(first, keys[0], "right")
    for value in np.unique(keys[0][right > out]):
        rows = keys[0] == value
        a, b = np.searchsorted(first, value, "left"), np.searchsorted(first, value, "right")
        out[rows] = a + locate([k[rows] for k in keys[1:]], [s[1:] for s in splitters[a:b]])
    return out


def _histogram(keyed: DataFrame, intervals: list[Interval]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(interval, bucket) -> exact bytes, smallest and largest value in the bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, size = [b.column(c).to_numpy() for c in KEY], b.column("size").to_numpy()
            order = np.lexsort(keys[::-1])
            keys, size = [k[order] for k in keys], size[order]
            for number, x in enumerate(intervals):
                lo, hi = 0, len(size)
                for k, value in enumerate(x.prefix):
                    lo, hi = lo + np.searchsorted(keys[k][lo:hi], value, "left"), lo + np.searchsorted(keys[k][lo:hi], value, "right")
                values = keys[len(x.prefix)][lo:hi]
                a, z = np.searchsorted(values, x.lo, "left"), np.searchsorted(values, x.hi, "right")
                values, sizes = values[a:z], size[lo + a : lo + z]
                if len(values):
                    bucket = (values - x.lo) // x.step
                    edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket) > 0]))
                    last = np.append(edge[1:], len(values)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), number, np.int32)), pa.array(bucket[edge]), pa.array(np.add.reduceat(sizes, edge)), pa.array(values[edge]), pa.array(values[last])], names=["interval", "bucket", "bytes", "least", "most"])

    rows = keyed.select(*KEY, "size").mapInArrow(run, "interval int, bucket long, bytes long, least long, most long").groupBy("interval", "bucket").agg(F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    return {(r["interval"], r["bucket"]): (r["bytes"], r["least"], r["most"]) for r in rows}


def find_splitters(keyed: DataFrame, total: int, parts: int, every: int, tolerance: float = TOLERANCE, part_tolerance: float = PART_TOLERANCE) -> list[tuple[int, int, int]]:
    """parts - 1 keys in order; each `every`-th bounds shards and meets `tolerance` of a shard's bytes, the others
    `part_tolerance` of a part's, as far as single rows allow."""
    found: dict[int, tuple[int, int, int]] = {}
    open_ = {j: (Interval((), 0, TOP - 1), 0) for j in range(1, parts)}
    while open_:
        intervals = sorted({x for x, _ in open_.values()}, key=lambda x: (x.prefix, x.lo))
        counts = _histogram(keyed, intervals)
        cells: dict[Interval, list[tuple[int, int, int, int]]] = {x: [] for x in intervals}
        for (n, b), cell in sorted(counts.items()):
            cells[intervals[n]].append((b, *cell))
        for j, (x, below) in list(open_.items()):
            target = total * j / parts
            allowed = tolerance * total * every / parts if j % every == 0 else part_tolerance * total / parts
            sums = [below]
            for cell in cells[x]:
                sums.append(sums[-1] + cell[1])
            pad = (0,) * (2 - len(x.prefix))
            edges = [(abs(sums[k] - target), k) for k in range(len(cells[x]))]
            near, k = min(edges)
            if near <= allowed:
                found[j] = (*x.prefix, cells[x][k][2], *pad)
                del open_[j]
                continue
            k = min(max(bisect_right(sums, target) - 1, 0), len(cells[x]) - 1)
            _, _, least, most = cells[x][k]
            if least < most:
                open_[j] = (Interval(x.prefix, least, most), sums[k])
            elif len(x.prefix) < 2:
                open_[j] = (Interval((*x.prefix, least), 0, TOP - 1), sums[k])
            else:  # one row lies across the target: the nearer of its two edges
                after = target - sums[k] > sums[k + 1] - target
                found[j] = (*x.prefix, least + after, *pad)
                del open_[j]
    keys, highest = [], (0, 0, 0)
    for j in range(1, parts):
        highest = max(highest, found[j])
        keys.append(highest)
    return keys


def shard_documents(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each document: the id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 1. Shards hold nearly equal sums of sizes; slots run from 0 without gaps in
    each shard. Equal texts share a shard where the tolerance leaves room for it; a larger group of copies is split at
    a document. Null texts count as a group of no bytes, null ids are ordered like any others, repeated rows are
    placed each; a very long text takes what it needs of its shard; an empty table gives no rows; other columns are
    not read.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    down = lambda c: F.shiftrightunsigned(c, 2)  # noqa: E731  to 62 bits
    keyed = written(
        df.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("crc"),
            down(F.xxhash64(text)).alias("h1"),
            down(F.xxhash64(F.col(id_col))).alias("h2"),
        ).withColumn("h3", F.monotonically_increasing_id()),
        "sharding",
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    every = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_PARTS) // shards)
    parts = shards * every
    splitters = find_splitters(keyed, total, parts, every, tolerance) if total else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = locate([b.column(c).to_numpy() for c in KEY], splitters) if splitters else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], names=[*b.schema.names, "part"])

    schema = T.StructType([*keyed.schema.fields, T.StructField("part", T.IntegerType())])
    placed = keyed.mapInArrow(place, schema)
    rows = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    firsts = [sum(rows.get(p, 0) for p in range(part // every * every, part)) for part in range(parts)]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.repartitionById(parts, F.col("part"))
        .sortWithinPartitions(*KEY)
        .withColumn("row", within)
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            F.floor(F.col("part") / every).cast("int").alias("shard"),
            (F.get(F.array(*[F.lit(n).cast("long") for n in firsts]), F.col("part")) + F.col("row")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
