"""Approximate nearest vectors: layered small-world graphs, one for each shard of the vectors.

Vectors are dealt by a hash of their id into shards of at most about SHARD_BYTES and SHARD_ROWS. A shard's different vectors
are nodes, in an order drawn at random; layer l holds the first n / FANOUT ** l of them, so a layer is a prefix of the
one below. Links go to near nodes in different directions: a candidate is passed over where a link already taken is
nearer to it than the node is. Links go both ways as far as there is room, and every node can be reached.

A search goes down the layers and keeps the `beam` best nodes of the lowest. A filter acts before the cut: nodes without
a permitted id are walked over but never kept, the beam grows as the permitted share falls, and a shard with few permitted
nodes is scored whole. Hits are scored again in double precision, as exact search scores them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from granary.operators.postings import shard_of
from granary.sources.landing import landing_path, spread

LINKS, CANDIDATES, FANOUT, TOP_LAYER = 24, 64, 16, 32
SHARD_ROWS, SHARD_BYTES = 1 << 15, 16 << 20
BEAM = 192
#: The beam of the layers above the lowest.
ENTER = 8
#: A shard with at most this share of permitted nodes is scored whole.
FEW = 0.125
#: Queries that walk together, and rows of one block of products.
TOGETHER, BLOCK = 256, 256
ROW = "shard int, width int, ids array<{}>, vectors binary, node binary, layers array<binary>"


@dataclass(frozen=True)
class Graph:
    """rows: one of each shard and length of vectors. shards: in how many the ids are dealt."""

    rows: DataFrame
    shards: int


# --- building -----------------------------------------------------------------


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is scaled by its largest part first, so that squares stay finite."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).astype(np.float32)


def _spread_links(unit: np.ndarray, links: int, candidates: int) -> np.ndarray:
    """For each node at most `links` near nodes that lie in different directions, nearest first; -1 where there are fewer."""
    n, k = len(unit), min(candidates, len(unit) - 1)
    out = np.full((n, links), -1, dtype=np.int32)
    for a in range(0, n, BLOCK):
        here = np.arange(a, min(a + BLOCK, n))
        sims = unit[here] @ unit.T
        sims[np.arange(len(here)), here] = -np.inf
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        s = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, axis=1), np.take_along_axis(s, order, axis=1)
        among = unit[near] @ unit[near].transpose(0, 2, 1)
        taken, count = np.zeros(near.shape, dtype=bool), np.zeros(len(here), dtype=np.int64)
        for j in range(k):
            hidden = (taken & (among[:, j, :] > s[:, j, None])).any(axis=1)
            take = ~hidden & (count < links)
            taken[:, j] = take
            out[here[take], count[take]] = near[take, j]
            count += take
    return out


def _both_ways(unit: np.ndarray, out: np.ndarray) -> list[list[int]]:
    """Each node's links, and of the nodes that link to it the nearest, to twice as many as `out` is wide."""
    n, links = out.shape
    a = np.repeat(np.arange(n), links)[out.ravel() >= 0]
    b = out.ravel()[out.ravel() >= 0]
    known = [set(row[row >= 0].tolist()) for row in out]
    s = np.concatenate([np.einsum("ij,ij->i", unit[a[k : k + 65536]], unit[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)])
    got = [row[row >= 0].tolist() for row in out]
    for e in np.argsort(-s, kind="stable"):
        x, y = int(b[e]), int(a[e])
        if len(got[x]) < 2 * links and y not in known[x]:
            known[x].add(y)
            got[x].append(y)
    return got


def _reach_all(unit: np.ndarray, got: list[list[int]]) -> None:
    """Adds links until every node can be reached from node 0, where every walk may begin."""
    n = len(unit)
    reached, best, by = np.zeros(n, dtype=bool), np.full(n, -np.inf, dtype=np.float32), np.zeros(n, dtype=np.int64)
    front = [0]
    while True:
        new = []
        while front:
            fresh = [x for x in dict.fromkeys(front) if not reached[x]]
            reached[fresh] = True
            new += fresh
            front = [y for x in fresh for y in got[x] if not reached[y]]
        left = np.flatnonzero(~reached)
        if not len(left):
            return
        for k in range(0, len(new), BLOCK):
            sims = unit[left] @ unit[new[k : k + BLOCK]].T
            at = sims.argmax(axis=1)
            s = sims[np.arange(len(left)), at]
            nearer = s > best[left]
            best[left[nearer]], by[left[nearer]] = s[nearer], np.asarray(new[k : k + BLOCK])[at[nearer]]
        x = int(left[best[left].argmax()])
        got[int(by[x])].append(x)
        got[x].append(int(by[x]))
        front = [x]


def layers_of(unit: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES) -> list[np.ndarray]:
    """The link table of each layer, lowest first; the highest, of at most TOP_LAYER nodes, has none: it is scored whole."""
    sizes, out = [len(unit)], []
    while sizes[-1] > TOP_LAYER:
        sizes.append(max(1, sizes[-1] // FANOUT))
    for size in sizes[:-1]:
        got = _both_ways(unit[:size], _spread_links(unit[:size], links, candidates))
        _reach_all(unit[:size], got)
        table = np.full((size, max(map(len, got))), -1, dtype=np.int32)
        for x, row in enumerate(got):
            table[x, : len(row)] = row
        out.append(table)
    return out


def _shard_row(key: tuple, table: pa.Table, id_type: pa.DataType, schema: pa.Schema) -> pa.Table:
    table = table.sort_by("id")
    width = key[1].as_py()
    v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, width)
    distinct, node = np.unique(_unit(v), axis=0, return_inverse=True)
    order = np.random.default_rng(len(distinct)).permutation(len(distinct))
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    layers = [x.tobytes() for x in layers_of(distinct[order])]
    cells = [[key[0].as_py()], [width], [table.column("id").to_pylist()], [v.tobytes()], [place[node.ravel()].astype(np.int32).tobytes()], [layers]]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)


def write_graph(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "vector", shard_rows: int = SHARD_ROWS) -> None:
    """Builds the graphs of (id, vector) rows under `path`, in place of those that are there.

    Vectors that are null, empty, zero or hold a null or a non-finite number have no place, nor have rows without an id;
    repeated ids are rows of their own. Vectors of several lengths get graphs of their own. Other columns aren't read.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = spread(vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    most = max(1, min(shard_rows, SHARD_BYTES // (8 * width)))
    shards = max(1, -(-n // most), min(spark.sparkContext.defaultParallelism, n // 2000))
    schema = T._parse_datatype_string(ROW.format(kind.simpleString()))
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        return _shard_row(key, table, to_arrow_type(kind), arrow)

    placed = rows.withColumns({"shard": shard_of(F.col("id"), F.lit(shards)), "width": F.size("v")})
    dealt = placed.repartition(min(shards, 8 * spark.sparkContext.defaultParallelism), "shard")
    built = dealt.groupBy("shard", "width").applyInArrow(build, schema).withColumn("shards", F.lit(shards))
    built.write.mode("overwrite").option("maxRecordsPerFile", 1).parquet(path)  # rows are large: no reader's batch holds two


def load_graph(spark: SparkSession, path: str) -> Graph:
    """The graphs that write_graph() left under `path`; without any, FileNotFoundError."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        raise FileNotFoundError(f"no complete graph at {path}: build it with write_graph()")
    rows = spark.read.parquet(path)
    return Graph(rows.drop("shards"), rows.agg(F.coalesce(F.max("shards"), F.lit(1))).first()[0])


def build_graph(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector") -> Graph:
    """The graphs of vectors for this application, in the shared folder."""
    path = landing_path(vectors.sparkSession, "graph")
    write_graph(vectors, path, id_col, vector_col)
    return load_graph(vectors.sparkSession, path)


# --- searching ----------------------------------------------------------------


def walk(unit: np.ndarray, layers: list[np.ndarray], q: np.ndarray, beam: int, permitted: np.ndarray | None = None) -> np.ndarray:
    """The nodes that a walk keeps for each row of q, -1 where there are fewer; all rows of q walk at once.

    With `permitted` (a mark for each node), only marked nodes are kept: where few are, all of them, else those among a
    beam that is wider by the inverse of their share.
    """
    n = len(unit)
    if permitted is not None:
        marked = np.flatnonzero(permitted)
        if len(marked) <= max(beam, FEW * n):
            return _best(q @ unit[marked].T, marked, beam)
        beam = min(n, -(-beam * n // len(marked)))
    top = n if not layers else max(1, len(layers[-1]) // FANOUT)
    found = _best(q @ unit[:top].T, np.arange(top), beam if not layers else ENTER)
    for level in range(len(layers) - 1, -1, -1):
        found = _descend(unit, layers[level], q, found, beam if level == 0 else ENTER)
    if permitted is not None:
        found = np.where((found >= 0) & permitted[found], found, -1)
    return found


def _best(sims: np.ndarray, nodes: np.ndarray, k: int) -> np.ndarray:
    if k >= len(nodes):
        return np.broadcast_to(nodes, (len(sims), len(nodes))).copy()
    return nodes[np.argpartition(-sims, k, axis=1)[:, :k]]


def _descend(unit: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> np.ndarray:
    """From the start nodes along links of one layer, the best node not yet left first, until none can better the beam."""
    size, width = len(q), max(beam, start.shape[1])
    kept, sims = np.full((size, width), -1, dtype=np.int64), np.full((size, width), -np.inf, dtype=np.float32)
    left = np.zeros((size, width), dtype=bool)  # nodes whose links were followed
    seen = np.zeros((size, len(links)), dtype=bool)
    kept[:, : start.shape[1]] = start
    sims[:, : start.shape[1]] = np.einsum("qcd,qd->qc", unit[start], q)
    np.put_along_axis(seen, start, True, axis=1)
    going = np.arange(size)
    while len(going):
        open_ = np.where(left[going] | (kept[going] < 0), -np.inf, sims[going])
        at = open_.argmax(axis=1)
        more = open_[np.arange(len(going)), at] > -np.inf
        going, at = going[more], at[more]
        if not len(going):
            break
        left[going, at] = True
        reach = links[kept[going, at]]
        new = (reach >= 0) & ~seen[going[:, None], reach]
        row, col = np.nonzero(new)
        node = reach[row, col]
        seen[going[row], node] = True
        got = np.full(reach.shape, -np.inf, dtype=np.float32)
        got[row, col] = np.einsum("ij,ij->i", unit[node], q[going[row]])
        both = np.concatenate([sims[going], got], axis=1)
        order = np.argpartition(-both, width - 1, axis=1)[:, :width]
        sims[going] = np.take_along_axis(both, order, axis=1)
        kept[going] = np.where(np.isneginf(sims[going]), -1, np.take_along_axis(np.concatenate([kept[going], reach], axis=1), order, axis=1))
        left[going] = np.take_along_axis(np.concatenate([left[going], np.zeros(reach.shape, dtype=bool)], axis=1), order, axis=1)
    return kept


def search_shards(graph: Graph, kept: DataFrame | None, shared, kind: T.DataType, top: int, beam: int, score) -> DataFrame:
    """(query_id, id, score): the hits of each shard for a block of queries (ids, vectors). kept: (shard, kept) or None,
    all permitted. score gives (n, rows of q, rows of v) their exact measure."""
    rows = graph.rows.withColumn("kept", F.lit(None).cast(graph.rows.schema["ids"].dataType)) if kept is None else graph.rows.join(kept, "shard")
    id_type = graph.rows.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                if one.column("width")[0].as_py() == q.shape[1]:
                    yield from _search_row(one, names, q, arrow, top, beam, score, schema.names)

    return rows.mapInArrow(run, schema)


def _search_row(one: pa.RecordBatch, names: pa.Array, q: np.ndarray, id_type: pa.DataType, top: int, beam: int, score, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """One shard: its nodes are walked by all queries, a few hundred at a time; a node's permitted copies are hits in order of id."""
    v = np.frombuffer(one.column("vectors")[0].as_py()).reshape(-1, q.shape[1])
    node = np.frombuffer(one.column("node")[0].as_py(), dtype=np.int32)
    ids = one.column("ids").flatten()
    fine = np.arange(len(node))
    if one.column("kept")[0].is_valid:
        fine = np.flatnonzero(pc.is_in(ids, value_set=one.column("kept").flatten()).to_numpy(zero_copy_only=False))
    fine = fine[np.argsort(node[fine], kind="stable")]  # rows by node; ids stand in order
    n = int(node.max()) + 1
    count = np.bincount(node[fine], minlength=n)
    first = np.cumsum(count) - count
    unit = np.empty((n, v.shape[1]), dtype=np.float32)
    unit[node] = _unit(v)
    links = [np.frombuffer(x, dtype=np.int32) for x in one.column("layers")[0].as_py()]
    sizes = [n]
    while len(sizes) < len(links):
        sizes.append(max(1, sizes[-1] // FANOUT))
    layers = [x.reshape(size, -1) for x, size in zip(links, sizes, strict=True)] if links else []
    permitted = None if len(fine) == len(node) else count > 0
    walkers = np.flatnonzero(np.abs(q).max(axis=1) > 0)
    for a in range(0, len(walkers), TOGETHER):
        who = walkers[a : a + TOGETHER]
        found = walk(unit, layers, _unit(q[who]), max(beam, top), permitted)
        asked, col = np.nonzero(found >= 0)
        at = found[asked, col]
        times = np.minimum(count[at], top)  # more copies than `top` of one node can't all be hits
        asked, start = np.repeat(asked, times), np.repeat(first[at], times)
        nth = np.arange(len(start)) - np.repeat(np.cumsum(times) - times, times)
        hit = fine[start + nth]
        s = score(q[who[asked]], v[hit])
        order = np.lexsort((hit, -s, asked))
        place = np.arange(len(order)) - np.searchsorted(asked[order], asked[order])
        order = order[place < top]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(who[asked[order]])), ids.take(pa.array(hit[order])), pa.array(s[order])], names=columns)
