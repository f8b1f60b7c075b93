"""Postings in blocks, and a search that skips blocks.

Texts are dealt by a hash of their id into shards of about SHARD_POSTINGS postings, so a frequent term's list is spread over
all shards. In a shard, a term's list is sorted by text and cut into blocks; each block's first text and greatest impact
stand beside it. Impacts hold everything of a score but the query's own weight of the term.

A query adds up lists by falling greatest impact. Once what the lists still to come could add together is below the k-th
best score so far, no other text can come in: from then on only texts that can still reach that score are looked up, in
the blocks that may hold them, and blocks without such a text are never read. Scores are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 64
#: Lists of at most so many blocks are added so many at a time; before each longer one, the k-th best score is known.
SHORT, TOGETHER = 8, 8
SHARD_POSTINGS = 1 << 20
#: Rows that aren't a term's: the shard's texts, and those that a filter lets through. No token is like them.
TEXTS, KEPT = "", "\x00"
#: Scores are rounded to six decimals before they are ranked, so what is nearer than this may tie.
MARGIN = 2e-6


def shards_for(postings: int, cores: int) -> int:
    """Shards of at most about SHARD_POSTINGS; smaller ones where there would be fewer than tasks to fill the cores."""
    return max(1, -(-postings // SHARD_POSTINGS), min(cores, postings // 20_000))


def shard_of(text_id: Column, shards: Column) -> Column:
    return F.pmod(F.xxhash64(text_id), shards).cast("int")


def block_schema(id_type: T.DataType) -> T.StructType:
    packed = [T.StructField(name, T.BinaryType()) for name in ("texts", "impacts", "first", "most")]
    return T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("term", T.StringType()), *packed, T.StructField("ids", T.ArrayType(id_type))])


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of runs of values of these sizes, as one array over the values themselves; a null at the end."""
    ends = np.concatenate([[0], np.cumsum(sizes) * values.itemsize, [values.nbytes]]).astype(np.int64)
    known = np.packbits(np.arange(len(sizes) + 1) < len(sizes), bitorder="little")
    packed = pa.Array.from_buffers(pa.large_binary(), len(sizes) + 1, [pa.py_buffer(known.tobytes()), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])
    return packed.cast(pa.binary())


def blocks_of(impacts: DataFrame, shards: int) -> DataFrame:
    """impacts (id, term, impact) -> a row for each shard and term, and one of each shard's ids in order.

    A shard is one task's work and of bounded size; equal ids are one text."""
    kind = impacts.schema["id"].dataType
    schema = block_schema(kind)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(ids.dictionary, null_placement="at_start")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        terms = table.column("term").combine_chunks().dictionary_encode()
        text, term, impact = rank[ids.indices.to_numpy()], terms.indices.to_numpy(), table.column("impact").to_numpy()
        by = np.argsort(term.astype(np.int64) * len(order) + text, kind="stable")
        text, term, impact = text[by], term[by], impact[by]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(text) != 0)]))
        text, term, impact = text[new], term[new], np.add.reduceat(impact, new)
        start = np.flatnonzero(np.concatenate([[True], np.diff(term) != 0]))
        size = np.diff(np.append(start, len(term)))
        blocks = -(-size // BLOCK)
        block = np.repeat(start, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        most = np.maximum.reduceat(impact, block)
        columns = [_packed(v, n) for v, n in ((text, size), (impact, size), (text[block], blocks), (most, blocks))]
        names = pa.concat_arrays([terms.dictionary.take(pa.array(term[start])), pa.array([TEXTS])])
        shard, n = key[0].as_py(), len(names)
        id_lists = pa.ListArray.from_arrays(pa.array([0] * n + [len(order)], pa.int32()), ids.dictionary.take(order))
        return pa.Table.from_arrays([pa.array([shard] * n, pa.int32()), names, *columns, id_lists], names=schema.names)

    dealt = impacts.select(shard_of(F.col("id"), F.lit(shards)).alias("shard"), "id", "term", "impact")
    return dealt.groupBy("shard").applyInArrow(build, schema).sortWithinPartitions("term", "shard")


class Shard:
    """The lists of one shard that some queries ask for. `read` counts the blocks looked into, `there` those of the lists."""

    def __init__(self, table: pa.Table):
        self.rows = {term: k for k, term in enumerate(table.column("term").to_pylist())}
        self.columns = {name: table.column(name).combine_chunks() for name in ("texts", "impacts", "first", "most")}
        ids = table.column("ids").combine_chunks()
        self.ids = ids[self.rows[TEXTS]].values
        self.allowed = np.ones(len(self.ids), dtype=bool)
        if KEPT in self.rows:
            self.allowed = pc.is_in(self.ids, value_set=ids[self.rows[KEPT]].values).to_numpy(zero_copy_only=False)
        self.lists: dict[str, tuple] = {}
        self.read = self.there = 0

    def list_of(self, term: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """texts, impacts, first and most of a term, views of what was read, and its greatest impact."""
        if term not in self.lists:
            views = [np.frombuffer(self.columns[name][self.rows[term]].as_buffer(), kind) for name, kind in (("texts", np.int32), ("impacts", np.float64), ("first", np.int32), ("most", np.float64))]
            self.lists[term] = (*views, float(views[3].max()))
        return self.lists[term]

    def search(self, asked: list[tuple[str, float]], top: int) -> tuple[np.ndarray, np.ndarray]:
        """(texts, scores) of the `top` best texts of a query of weighted terms, above 0, ties in order of the ids."""
        found = [(w, self.list_of(t), t) for t, w in asked if t in self.rows and t not in (TEXTS, KEPT)]
        lists = sorted(found, key=lambda x: (x[0] >= 0, -x[0] * x[1][4], x[2]))
        coming = np.append(np.cumsum([max(w * x[4], 0.0) for w, x, _ in lists][::-1])[::-1], 0.0)
        score, least, k = np.zeros(len(self.ids)), 0.0, 0
        while k < len(lists) and (least <= 0 or coming[k] >= least - MARGIN or lists[k][0] < 0):
            some = [lists[k]]
            while len(some) < TOGETHER and k + len(some) < len(lists) and len(lists[k + len(some)][1][2]) <= SHORT:
                some.append(lists[k + len(some)])
            score += np.bincount(np.concatenate([x[0] for _, x, _ in some]), np.concatenate([w * x[1] for w, x, _ in some]), len(score))
            blocks = sum(len(x[2]) for _, x, _ in some)
            self.read, self.there, k = self.read + blocks, self.there + blocks, k + len(some)
            least = self._kth(score[self.allowed], top)
        open_ = np.flatnonzero((score > 0) & (score + coming[k] >= least - MARGIN) & self.allowed)
        for n in range(k, len(lists)):
            weight, (texts, impacts, first, most, _), _ = lists[n]
            block = np.searchsorted(first, open_, "right") - 1
            able = score[open_] + np.where(block >= 0, weight * most[block], 0.0) + coming[n + 1] >= least - MARGIN
            open_, block = open_[able], block[able]
            self.read, self.there = self.read + len(np.unique(block[block >= 0])), self.there + len(first)
            at = np.minimum(np.searchsorted(texts, open_), len(texts) - 1)
            found = texts[at] == open_
            score[open_[found]] += weight * impacts[at[found]]
            least = max(least, self._kth(score[open_], top))
        rounded = np.floor(score[open_] * 1e6 + 0.5) / 1e6
        best = np.lexsort((open_, -rounded))[:top]
        best = best[rounded[best] > 0]
        return open_[best], rounded[best]

    @staticmethod
    def _kth(scores: np.ndarray, top: int) -> float:
        return float(np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) >= top else 0.0


def query_blocks(asked: DataFrame, weights: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[list[tuple[str, float]]]]]:
    """Query ids with their weighted terms, in blocks of bounded bytes that come to the driver one after another.

    asked: (query_id, terms), a repeated term as often as it is repeated; weights: (term, idf). Terms of no text are left out.
    """
    def weighted(rows: list) -> tuple[list, list[list[tuple[str, float]]]]:
        terms = asked.sparkSession.createDataFrame(pa.table({"term": pa.array(sorted({t for _, c in rows for t in c}), pa.string())}))
        idf = dict(map(tuple, weights.select("term", "idf").join(terms, "term", "left_semi").collect()))
        return [q for q, _ in rows], [[(t, n * idf[t]) for t, n in c.items() if t in idf] for _, c in rows]

    rows, held = [], 0
    for r in asked.groupBy("query_id").agg(F.flatten(F.collect_list("terms")).alias("terms")).toLocalIterator():
        if rows and held >= block_bytes:
            yield weighted(rows)
            rows, held = [], 0
        rows.append((r["query_id"], Counter(r["terms"])))
        held += sum(len(t) + 24 for t in rows[-1][1])
    if rows:
        yield weighted(rows)


def search_blocks(blocks: DataFrame, kept: DataFrame | None, ids: list, asked: list[list[tuple[str, float]]], query_type: T.DataType, top: int) -> DataFrame:
    """(query_id, id, score): the best texts of each shard for each query of one block. kept: (shard, ids) let through."""
    spark = blocks.sparkSession
    terms = spark.createDataFrame(pa.table({"term": sorted({t for terms in asked for t, _ in terms} | {TEXTS})}))
    rows = blocks.join(terms, "term", "left_semi").select(blocks.columns)
    if kept is not None:
        rows = rows.unionByName(kept.withColumn("term", F.lit(KEPT)), allowMissingColumns=True)
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    shared, arrow = spark.sparkContext.broadcast((ids, asked)), pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(table: pa.Table) -> pa.Table:
        ids, asked = shared.value
        if TEXTS not in table.column("term").to_pylist():  # ids of a shard without texts
            return arrow.empty_table()
        shard = Shard(table)
        found = [shard.search(terms, top) for terms in asked]
        texts = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
        of = np.repeat(np.arange(len(ids)), [len(f[0]) for f in found])
        return pa.Table.from_arrays([pa.array(ids, arrow.field("query_id").type).take(pa.array(of)), shard.ids.take(pa.array(texts)).cast(arrow.field("id").type), pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.float64())], schema=arrow)

    return rows.groupBy("shard").applyInArrow(run, schema)
