"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

1. Each text becomes its set of hashed word n-grams. Rows and bands are chosen for the target recall at the threshold.
2. Equal sets are one node, so copies cost nothing below. (band hash, node) pairs, two longs each, go from the signatures
   to the buckets, a node's once from each task however many copies the task has; every node of a bucket is tied to the
   bucket's smallest node, and the components of these ties hold all candidate pairs.
3. Texts of nodes that have a tie are fetched and their n-gram sets made anew. A component is verified in tiles: members
   are dealt to chunks of at most about TILE nodes, and each pair of chunks meets in one tile. Chunks are cut within
   classes of set size, as sets whose sizes differ by more than the threshold can't be similar; so only equal and
   neighbouring classes meet. A tile compares all its pairs by one matrix product, and returns a row for each node:
   how many documents it is linked to, and a spanning tie, never the pairs.
4. Components of the spanning ties are the classes.

The words of a text are those of decontamination.py. A text of fewer words than n, but some, has one n-gram; one
without words but with other characters has itself as its only n-gram; null and blank texts have none and no links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from granary.llm.common import slices, written
from granary.llm.components import components
from granary.llm.decontamination import words_of

WORDS, THRESHOLD, RECALL, MOST_HASHES, TILE = 5, 0.8, 0.9995, 384, 384
SEEN = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, that reach the recall within `most` hashes."""
    for rows in range(32, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngrams(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams."""
    words = words_of(text)
    if not words:
        rest = (text or b"").strip()
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + rest)] if rest else [], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _MIX + h[k : len(h) - n + 1 + k]
    return np.unique(_mixed(out))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        rnd = np.random.default_rng(seed)
        self.a = rnd.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rnd.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def band_hashes(self, sets: list[np.ndarray]) -> np.ndarray:
        """len(sets) x bands signed 64-bit hashes; the sets must not be empty."""
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out, v = np.empty((len(sets), self.bands), dtype=np.uint64), np.empty_like(x)
        for band in range(self.bands):
            h = np.full(len(sets), band + 1, dtype=np.uint64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                np.multiply(x, self.a[k], out=v)
                np.add(v, self.b[k], out=v)
                h = h * _MIX + np.minimum.reduceat(v, starts)
            out[:, band] = _mixed(h)
        return out.view(np.int64)


def _set_hash(grams: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())))) if len(grams) else None


def signatures(df: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """(id, thash, set, n, bands) of each row; set is null where there are no n-grams.

    Of the rows of a task with one set, only the first has bands, unless more than SEEN other sets came between.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType)] + T.StructType.fromDDL("thash long, set long, n int, bands array<long>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash, seen = MinHash(bands, rows), set()
        for part in slices(batches, "text"):
            if len(seen) > SEEN:
                seen.clear()
            sets = [ngrams(t, n) for t in part.column("text").cast(pa.binary()).to_pylist()]
            names = [_set_hash(s) for s in sets]
            full = [k for k, name in enumerate(names) if name is not None and not (name in seen or seen.add(name))]
            hashes: list[np.ndarray | None] = [None] * len(sets)
            if full:
                for k, row in zip(full, minhash.band_hashes([sets[k] for k in full]), strict=True):
                    hashes[k] = row
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("thash"), pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def similar_pairs(sets: list[np.ndarray], threshold: float, columns: int = 8192) -> np.ndarray:
    """Boolean matrix of the pairs of sets whose Jaccard similarity reaches the threshold."""
    exact = Fraction(threshold).limit_denominator(1000)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    grams, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    column = np.cumsum(count > 1) - 1  # a gram of one set is in no intersection
    kept = count[number] > 1
    row, column = row[kept], column[number[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, z = np.searchsorted(column, first), np.searchsorted(column, first + columns)
        grid = np.zeros((len(sets), columns), dtype=np.float32)
        grid[row[a:z], column[a:z] - first] = 1
        shared += grid @ grid.T
    shared = shared.astype(np.int64)
    similar = exact.denominator * shared >= exact.numerator * (sizes[:, None] + sizes - shared)
    np.fill_diagonal(similar, False)
    return similar


def _tile(nodes: np.ndarray, sides: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, int]]:
    """(node, documents linked to it, a node of its class) for the nodes that have links in this tile."""
    similar = similar_pairs(sets, threshold)
    if sides.any():
        similar &= sides[:, None] != sides
    links = similar @ copies
    root = np.arange(len(nodes))
    while True:  # each node takes the smallest number around it
        low = np.minimum(root, np.where(similar, root, len(nodes)).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    for k in np.flatnonzero(links):
        yield int(nodes[k]), int(links[k]), int(nodes[root[k]])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, seen = None, [], set()

        def flush():
            found = list(_tile(np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held]), [h[3] for h in held], threshold)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["a", "links", "b"])

        for batch in batches:
            for key, node, side, copies, grams in zip(*(batch.column(c).to_pylist() for c in ("tile", "set", "side", "copies", "grams")), strict=True):
                if key != tile:
                    yield flush()
                    tile, held, seen = key, [], set()
                if node not in seen:
                    seen.add(node)
                    held.append((node, side, copies, np.frombuffer(grams, np.uint64)))
        yield flush()

    return run


def _tiles(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes (set, comp, n, ...) with tiles: an array of (tile, side)."""
    sized = nodes.withColumn("k", F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int"))
    classes = sized.groupBy("comp", "k").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("chunks"), F.count("*").alias("m"))
    total = classes.groupBy("comp").agg(F.sum("m").alias("members"))
    beside = classes.select("comp", (F.col("k") - 1).alias("k"), F.col("chunks").alias("above"))
    under = classes.select("comp", (F.col("k") + 1).alias("k"), F.col("chunks").alias("below"))
    plan = written(classes.join(beside, ["comp", "k"], "left").join(under, ["comp", "k"], "left").join(total, "comp"), "tiles").drop("m")
    key = lambda *c: F.xxhash64("comp", *c)
    s, k = F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int"), F.col("k")
    upto = lambda c: F.when(c >= 1, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    one = F.array(F.struct(key(F.lit(-1)).alias("tile"), F.lit(0).alias("side")))
    same = F.transform(upto(F.col("chunks")), lambda t: F.struct(key(k, k, F.least(s, t), F.greatest(s, t)).alias("tile"), F.when(s > t, 1).otherwise(0).alias("side")))
    up = F.transform(upto(F.coalesce("above", F.lit(0))), lambda t: F.struct(key(k, k + 1, s, t).alias("tile"), F.lit(0).alias("side")))
    down = F.transform(upto(F.coalesce("below", F.lit(0))), lambda t: F.struct(key(k - 1, k, t, s).alias("tile"), F.lit(1).alias("side")))
    return sized.join(plan, ["comp", "k"]).withColumn("tiles", F.when(F.col("members") <= TILE, one).otherwise(F.concat(same, up, down)))


def _classes(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> DataFrame:
    """(id, thash, class, links, copies) of each row; class is null for rows without n-grams."""
    bands, rows = choose_bands(threshold, recall)
    slim = written(signatures(df, id_col, text_col, n, bands, rows), "signatures")
    sets = slim.where("set is not null").groupBy("set").agg(F.min(F.struct("id", "thash")).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
    sets = written(sets, "sets")
    banded = slim.where("bands is not null").select("set", F.explode("bands").alias("band"))
    buckets = written(banded.groupBy("band").agg(F.min("set").alias("least"), F.max("set").alias("most")).where("least != most").select("band", "least"), "buckets")
    tied = components(banded.join(buckets, "band").select(F.col("set").alias("a"), F.col("least").alias("b")))
    nodes = _tiles(sets.join(tied.select(F.col("node").alias("set"), F.col("label").alias("comp")), "set"), threshold)
    nodes = nodes.select("set", "copies", "tiles", F.col("rep.id").alias("rid"), F.col("rep.thash").alias("rhash"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            grams = pa.array([ngrams(t, n).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("set"), part.column("copies"), part.column("tiles"), grams], names=["set", "copies", "tiles", "grams"])

    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("thash"), F.col(text_col).alias("text"))
    fetched = texts.join(nodes, F.col("id").eqNullSafe(F.col("rid")) & (F.col("thash") == F.col("rhash"))).select("set", "copies", "tiles", "text")
    spread = fetched.mapInArrow(make, "set long, copies long, tiles array<struct<tile:long,side:int>>, grams binary").select("set", "copies", "grams", F.explode("tiles").alias("t")).select("t.tile", "t.side", "set", "copies", "grams")
    found = written(spread.repartition("tile").sortWithinPartitions("tile", "side", "set").mapInArrow(_verify(threshold), "a long, links long, b long"), "links")
    joined = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
    labels = joined.select(F.col("node").alias("set"), F.col("label").alias("class"))
    known = sets.select("set", "copies").join(links, "set", "left").join(labels, "set", "left")
    known = written(known.select("set", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("class", "set").alias("class")), "classes")
    return slim.select("id", "thash", "set").join(known, "set", "left").select("id", "thash", "class", "links", "copies")


def ngram_jaccard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each row of df: the id, class_id and n_links.

    Two documents are linked if the Jaccard similarity of their n-gram sets reaches the threshold; n_links counts the
    other documents a document is linked to, copies each, and class_id is the smallest id among those it reaches over
    links. Null and blank texts have no links and their own id as class. Rows of one id are documents of their own; an
    empty table gives no rows; other columns are not read.
    """
    rows = _classes(df, id_col, text_col, n, threshold, recall)
    least = rows.where("class is not null").groupBy("class").agg(F.min("id").alias("class_id"))
    out = rows.join(written(least, "class-ids"), "class", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0).cast("long")).alias("n_links"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """df with one document of each class: that of the smallest id (null before others). Rows without n-grams stay.

    Of repeated rows with n-grams one stays; all columns stay as they are, whatever they are called; an empty table stays
    empty.
    """
    own = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    key, text = f"c{df.columns.index(id_col)}", f"c{df.columns.index(text_col)}"
    rows = _classes(own, key, text, n, threshold, recall)
    first = rows.where("class is not null").groupBy("class").agg(F.min(F.struct("id", "thash")).alias("f")).select(F.col("f.id").alias("id"), F.col("f.thash").alias("kept"))
    alone = rows.where("class is null").select("id", F.col("thash").alias("kept"), F.lit(True).alias("alone")).distinct()
    kept = written(first.withColumn("alone", F.lit(False)).unionByName(alone), "kept")
    found = own.withColumn("thash", F.xxhash64(text)).join(kept, F.col(key).eqNullSafe(F.col("id")) & (F.col("thash") == F.col("kept")))
    nth = F.row_number().over(Window.partitionBy("id", "kept").orderBy("alone"))
    return found.withColumn("nth", nth).where("alone or nth = 1").select(*own.columns).toDF(*df.columns)
