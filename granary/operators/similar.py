"""Groups of similar vectors, of any size: links in blocks, components, and what is folded inside a component.

Equal vectors of a group are one class, so copies are never compared with each other. Matrix products of bounded blocks find
which classes are similar, and leave no more links than connect them: a thousand near copies make a few thousand links, not
half a million pairs. Only items of one component can influence each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from granary.sources.landing import landed

#: Vectors of a block, and classes of a component that one task may hold.
BLOCK, MOST = 1500, 10_000


def met_in_blocks(rows: DataFrame, meet: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, block: int) -> DataFrame:
    """What meet(left, right, same) gives for every two blocks of each group of rows (group, id, v, ...).

    A group's vectors of one length are cut into blocks of about `block` rows by hash, and every two blocks meet once, so a
    task holds two blocks however large the group is. same: a block meets itself, and left is right.
    """
    rows = rows.withColumn("d", F.size("v"))
    sizes = rows.groupBy("group", "d").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, ["group", "d"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["own"] == pdf["i"]], pdf[pdf["own"] == pdf["j"]]
        return meet(left, right, bool(pdf["i"].iat[0] == pdf["j"].iat[0]))

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "group", "d", "i", "j").groupBy("group", "d", "i", "j").applyInPandas(run, schema)


def stacked(side: pd.DataFrame, width: int) -> np.ndarray:
    return np.stack(side["v"].to_list()) if len(side) else np.zeros((0, width))


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of enough true cells of a matrix to connect all rows and columns that its true cells connect."""
    rows, columns = [], []
    new_rows, new_columns = np.ones(near.shape[0], dtype=bool), np.ones(near.shape[1], dtype=bool)
    for start in range(near.shape[0]):
        if not new_rows[start]:
            continue
        new_rows[start], todo = False, [start]
        while todo:
            x = todo.pop()
            reached = np.flatnonzero(near[x] & new_columns)
            new_columns[reached] = False
            rows += [x] * len(reached)
            columns += reached.tolist()
            for y in reached.tolist():
                more = np.flatnonzero(near[:, y] & new_rows)
                new_rows[more] = False
                rows += more.tolist()
                columns += [y] * len(more)
                todo += more.tolist()
    return np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64)


def links(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of one group with an inner product of at least `threshold`, enough to connect all that such
    pairs connect; of two blocks no more than they have rows.

    vectors: group, id (a long, unique over all groups), v (doubles). Vectors with a null are in no pair. A pair that
    rounding leaves in doubt counts, as what is connected is looked at again.
    """
    def meet(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        width = len(left["v"].iat[0]) if len(left) else 0
        v, w = stacked(left, width), stacked(right, width)
        near = v @ w.T >= threshold - 1e-9 if len(v) and len(w) else np.zeros((len(v), len(w)), dtype=bool)
        if same:
            np.fill_diagonal(near, True)  # row and column are one
        x, y = forest(near)
        return pd.DataFrame({"x": left["id"].to_numpy()[x], "y": right["id"].to_numpy()[y]})

    whole = vectors.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull())).select("group", "id", "v")
    return met_in_blocks(whole, meet, "x long, y long", block).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): the smallest node that it is connected with.

    In each round a node's label falls to the smallest of its neighbours' labels, and then to the label of its label, so
    the rounds grow with the logarithm of a component's width in practice; each is landed.
    """
    both = landed(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    labels = landed(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        least = both.join(of_other, "other").groupBy("node").agg(F.min("near").alias("near"))
        stepped = labels.join(least, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = landed(stepped.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        moved = not after.where("was <> label").isEmpty()
        labels = after.select("node", "label")
        if not moved:
            return labels


def classes(items: DataFrame, apart: Column) -> DataFrame:
    """items (group, article_id, v, ...) -> (class, group, v, size), landed: equal vectors are one class but where `apart` holds."""
    single = F.when(apart, F.col("article_id"))
    grouped = items.groupBy("group", "v", single.alias("single")).agg(F.count("*").alias("size"))
    return landed(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")


def with_class(items: DataFrame, known: DataFrame, apart: Column) -> DataFrame:
    """items, landed without their vectors and with their class."""
    own = items.withColumn("single", F.when(apart, F.col("article_id")))
    k = known.select(F.col("group").alias("g"), F.col("v").alias("w"), F.col("single").alias("s"), "class")
    met = own.join(k, (F.col("group") == F.col("g")) & (F.col("v") == F.col("w")) & F.col("single").eqNullSafe(F.col("s")))
    return landed(met.drop("v", "w", "g", "s", "single"), "members")


# --- greedy order --------------------------------------------------------------


def nearest_of(rows: np.ndarray, v: np.ndarray) -> tuple[int, float]:
    """The first row of the greatest inner product with v, and that product, summed in element order as SQL engines do.

    A matrix product sums in an order of its own, so it only picks the rows that rounding may leave nearest; -1 of none.
    """
    if not len(rows):
        return -1, 0.0
    rough = rows @ v
    slack = 1e-14 * len(v) * (np.abs(v).max(initial=0.0) * np.abs(rows).max(initial=0.0) * len(v))
    at = np.flatnonzero(rough >= rough.max() - slack)
    if not len(at):  # not a number
        return -1, 0.0
    exact = np.cumsum(rows[at] * v, axis=1)[:, -1]
    best = int(exact.argmax())
    return int(at[best]), float(exact[best])


def leaders(members: DataFrame, labels: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(group, article_id, target) of the items of components: the item that each copy, or displaced original, points to.

    A component's items stream through one task by published_at and article_id; in memory are the vectors of those that
    stay, and an item is compared with these alone.
    """
    link = labels.select(F.col("node").alias("class"), "label").join(known.select("class", "v"), "class")
    items = members.join(link, "class").select("label", "group", "article_id", "published_at", "redirect", "v")
    rows = items.repartition("label").sortWithinPartitions("label", "published_at", "article_id").drop("published_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, names, stay = None, [], np.zeros((0, 0))
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                v = np.array(r["v"])
                if r["label"] != label:
                    label, names, stay = r["label"], [], np.zeros((8, len(v)))
                best, sim = nearest_of(stay[: len(names)], v)
                copy = sim > 0 and sim >= threshold
                replaces = copy and names[best][1] and not r["redirect"]
                if copy and not replaces:
                    out.append((r["group"], r["article_id"], names[best][0]))
                    continue
                if replaces:
                    out.append((r["group"], names[best][0], r["article_id"]))
                    stay[best : len(names) - 1] = stay[best + 1 : len(names)]
                    del names[best]
                if len(names) == len(stay):
                    stay = np.concatenate([stay, np.zeros_like(stay)])
                stay[len(names)] = v
                names.append((r["article_id"], r["redirect"]))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["group", "article_id", "target"])

    return rows.mapInArrow(run, "group string, article_id string, target string")


def copies(items: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(group, article_id, target): what each copy points to in the end. items: group, article_id, published_at, redirect, v.

    The first of a class that is like no other stays, or the first that doesn't redirect; these need no fold. An item that
    was displaced never comes back and its successor is never displaced, so pointers are followed once.
    """
    self_sim = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    apart = ~F.coalesce((self_sim >= threshold) & (self_sim > 0), F.lit(False))
    known = classes(items, apart)
    members = with_class(items, known, apart)
    labels = connected(links(known.select("group", F.col("class").alias("id"), "v"), threshold, block))
    lone = members.join(labels.select(F.col("node").alias("class")), "class", "left_anti")
    by_time = F.struct("published_at", "article_id")
    heads = lone.groupBy("class").agg(F.min(F.struct("published_at", "article_id", "redirect")).alias("first"), F.min(F.when(~F.col("redirect"), by_time)).alias("plain"))
    heads = heads.select("class", F.when(F.col("first.redirect"), F.coalesce("plain.article_id", "first.article_id")).otherwise(F.col("first.article_id")).alias("target"))
    same = lone.join(heads, "class").where(F.col("article_id") != F.col("target")).select("group", "article_id", "target")
    pointers = landed(leaders(members, labels, known, threshold), "pointers")
    after = pointers.select("group", F.col("article_id").alias("target"), F.col("target").alias("later"))
    return pointers.join(after, ["group", "target"], "left").select("group", "article_id", F.coalesce("later", "target").alias("target")).unionByName(same)


# --- average linkage ------------------------------------------------------------


def reciprocal_merges(nodes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(class, cluster) of average linkage in rounds: all clusters that are each other's nearest merge at once.

    nodes: group, class, v (a unit vector), size. A mean similarity is the product of two clusters' means; no merge brings
    a cluster nearer to others than its parts were, so the clusters are those of merging the nearest two each time, and one
    whose nearest isn't above the threshold is done. A round is one pass over blocks of the means that are still open.
    """
    def nearest(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        width = len(left["v"].iat[0]) if len(left) else 0
        v, w = stacked(left, width), stacked(right, width)
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        if not len(a) or not len(b) or (same and len(a) < 2):
            return pd.DataFrame({"id": [], "near": [], "sim": []})
        sim = v @ w.T
        if same:
            np.fill_diagonal(sim, -np.inf)
        out = []
        for own, other, s in ((a, b, sim), (b, a, sim.T))[: 1 if same else 2]:
            top = s.max(axis=1)
            first = np.where(s == top[:, None], other[None, :], np.iinfo(np.int64).max).min(axis=1)
            out.append(pd.DataFrame({"id": own, "near": first, "sim": top}))
        return pd.concat(out)

    open_ = landed(nodes.select("group", F.col("class").alias("id"), F.transform("v", lambda x: x * F.col("size")).alias("total"), F.col("size").cast("double").alias("size")), "open")
    clusters = landed(nodes.select("class", F.col("class").alias("cluster")), "clusters")
    while True:
        means = open_.select("group", "id", F.transform("total", lambda x: x / F.col("size")).alias("v"))
        found = met_in_blocks(means, nearest, "id long, near long, sim double", block)
        near = landed(found.groupBy("id").agg(F.max(F.struct("sim", (-F.col("near")).alias("less"))).alias("m")).where(F.col("m.sim") > threshold).select("id", (-F.col("m.less")).alias("near"), "m.sim"), "near")
        back = near.select(F.col("id").alias("near"), F.col("near").alias("id"))
        pairs = landed(near.where("id < near").join(back, ["id", "near"]).select(F.col("id").alias("into"), F.col("near").alias("id")), "merges")
        if pairs.isEmpty():
            return clusters
        going_on = open_.join(near.select("id"), "id", "left_semi").join(pairs, "id", "left").withColumn("id", F.coalesce("into", "id"))
        summed = going_on.groupBy("group", "id").agg(F.sum("size").alias("size"), F.collect_list("total").alias("parts"))  # two parts at most
        open_ = landed(summed.select("group", "id", F.reduce(F.slice("parts", 2, 1), F.get("parts", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b)).alias("total"), "size"), "open")
        clusters = landed(clusters.join(pairs.select(F.col("id").alias("cluster"), "into"), "cluster", "left").select("class", F.coalesce("into", "cluster").alias("cluster")), "clusters")


def linked(items: DataFrame, threshold: float, linkage: Callable[[np.ndarray, float, np.ndarray], list[int]], block: int = BLOCK, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(members with their class, clusters): average linkage of items (group, article_id, v, ...), v of unit length.

    A mean above the threshold takes a pair above it, so clusters never cross components. Components of up to `most` classes
    are one task's work each (`linkage`), larger ones merge in rounds. clusters: (class, cluster), of components only.
    """
    apart = ~F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    known = classes(items, apart)
    members = with_class(items, known, apart)
    labels = connected(links(known.select("group", F.col("class").alias("id"), "v"), threshold, block))
    sizes = labels.groupBy("label").agg((F.count("*") > most).alias("large"))
    nodes = landed(known.join(labels.join(sizes, "label").select(F.col("node").alias("class"), "label", "large"), "class").select("label", "large", "class", "v", "size"), "nodes")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class")
        names = pdf["class"].to_numpy()
        return pd.DataFrame({"class": names, "cluster": names[linkage(np.stack(pdf["v"].to_list()), threshold, pdf["size"].to_numpy(dtype=float))]})

    clusters = nodes.where("not large").groupBy("label").applyInPandas(fold, "class long, cluster long")
    if not nodes.where("large").isEmpty():
        clusters = clusters.unionByName(reciprocal_merges(nodes.where("large").select(F.col("label").alias("group"), "class", "v", "size"), threshold, block))
    return members, clusters
