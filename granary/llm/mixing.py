"""Mixing sources to target weights by cube-method balanced sampling.

A source's target is a share of all words, by weight, up to `most` times its own. target / source size is how often each
of its documents is taken on average: its whole part is certain, its fraction is the probability that the document is
taken once more. The cube method turns these probabilities into 0 and 1 and holds two totals of each source, documents
and words: three documents have one direction in which to move their probabilities that changes neither total (the null
space of the two constraints), and moving along it, forwards or backwards at random, fixes at least one of them.

Rows are dealt into blocks by a hash, so a hot source is spread like any other. In a block each source is walked through
by falling size with at most three documents open; the one or two that stay open (all of like, small size) go on to the
next level, where many blocks are one, until one block is left. There at most LANDING documents of a source are open:
of all their subsets with a right number of documents the one nearest in words is taken.

Documents of more than the LARGE-th part of a source's words (fewer than LARGE of each source) come first, in a flight and
a landing of their own, as small ones can't make up for a large one that is still open at the end. By what they miss of
their share, the chance of the source's other documents is then moved.

Nothing depends on how the table is partitioned, so reruns agree, also on other machines.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from granary.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a block, blocks that meet at the next level, open documents of a source that are landed.
BLOCK_ROWS, FAN, LANDING = 1024, 128, 12
LARGE = 64
EPSILON = 1e-9
COLUMNS = ("size", "source_size", "target", "taken", "copies")


def step(units: list[list], rnd: random.Random) -> None:
    """Moves the chances of three units, or of two of one size, so that one becomes 0 or 1. Units: [chance, size, ...], by
    falling size; of more than three, it takes those most alike in size, so that sizes of all kinds are left for landing."""
    first = min(range(max(1, len(units) - 2)), key=lambda k: (units[k][1] - units[min(k + 2, len(units) - 1)][1]) / (units[k][1] + 1))
    three = units[first : first + 3]
    sizes = [u[1] for u in three]
    if len(three) == 3 and not sizes[0] == sizes[1] == sizes[2]:
        way = [sizes[1] - sizes[2], sizes[2] - sizes[0], sizes[0] - sizes[1]]
    else:
        three, way = three[:2], [1, -1]
    ahead = min(((1 - u[0]) / w if w > 0 else u[0] / -w) for u, w in zip(three, way, strict=True) if w)
    back = min((u[0] / w if w > 0 else (1 - u[0]) / -w) for u, w in zip(three, way, strict=True) if w)
    by = ahead if rnd.random() * (ahead + back) < back else -back
    for u, w in zip(three, way, strict=True):
        chance = u[0] + by * w
        u[0] = 0.0 if chance < EPSILON else 1.0 if chance > 1 - EPSILON else chance


def movable(units: list[list]) -> bool:
    return len(units) > 2 or len(units) == 2 and units[0][1] == units[1][1]


def land(units: list[list]) -> None:
    """Decides at most LANDING units: a subset off by less than a document, and of these the one nearest in sizes."""
    if not units:
        return
    chance, size = np.array([u[0] for u in units]), np.array([u[1] for u in units], dtype=np.float64)
    subsets = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    documents, words = np.abs(subsets.sum(1) - chance.sum()), np.abs(subsets @ size - chance @ size)
    words[documents > 1 - EPSILON] = np.inf
    best = subsets[np.lexsort((documents, np.round(words, 6)))[0]]
    for u, taken in zip(units, best, strict=True):
        u[0] = float(taken)


def flight(open_rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """One level: the rows with their chances moved. Groups are (block, source), walked in order of falling size."""
    at = open_rows.columns.index("chance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rnd = None, random.Random(0)
        units: list[list] = []  # of the group, still open: [chance, size, batch, row]
        held: list[list] = []  # those of earlier batches: `batch` is then a slice of one row

        def out(unit: list) -> pa.RecordBatch:
            columns = list(unit[2].columns)
            columns[at] = pa.array([unit[0]], pa.float64())
            return pa.RecordBatch.from_arrays(columns, schema=unit[2].schema)

        def ended() -> None:
            if last:
                land(units)
            units.clear()

        for batch in batches:
            chances = batch.column("chance").to_numpy().copy()
            here: list[list] = []
            for row, (block, number, size) in enumerate(zip(batch.column("block").to_pylist(), batch.column("number").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                if (block, number) != group:
                    ended()
                    group, rnd = (block, number), random.Random(f"{seed}:{level}:{block}:{number}")
                unit = [float(chances[row]), size, None, row]
                here.append(unit)
                units.append(unit)
                while movable(units) and not (last and len(units) <= LANDING):
                    step(units, rnd)
                    units[:] = [u for u in units if 0 < u[0] < 1]
            going_on = {id(u) for u in units}
            yield from (out(u) for u in held if id(u) not in going_on)
            held = [u for u in held if id(u) in going_on]
            for u in here:
                if id(u) in going_on:
                    u[2] = pa.RecordBatch.from_arrays([c.take(pa.array([u[3]])) for c in batch.columns], schema=batch.schema)
                    held.append(u)
                chances[u[3]] = u[0]
            gone = np.ones(batch.num_rows, dtype=bool)
            gone[[u[3] for u in here if id(u) in going_on]] = False
            columns = list(batch.columns)
            columns[at] = pa.array(chances)
            yield pa.RecordBatch.from_arrays([pc.filter(c, pa.array(gone)) for c in columns], schema=batch.schema)
        ended()
        yield from (out(u) for u in held)

    dealt = open_rows.repartition("block") if level == 0 else open_rows.repartition("block", "number")
    return dealt.sortWithinPartitions("block", "number", F.desc("size"), "key", "id").mapInArrow(run, open_rows.schema)


def numbered(sources: DataFrame) -> DataFrame:
    """sources with their number in code-point order, null last: counts of sorted ranges, summed, plus the place in each."""
    mask = F.lit((1 << 33) - 1)
    order = F.col("source").asc_nulls_last()
    ranged = written(sources.repartitionByRange(order).sortWithinPartitions(order).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(mask)}), "sources")
    before, firsts = 0, {}
    for part, many in sorted(tuple(r) for r in ranged.groupBy("part").count().collect()):
        firsts[part], before = before, before + many
    first = F.get(F.array(*[F.lit(firsts.get(p, 0)).cast("long") for p in range(max(firsts, default=0) + 1)]), F.col("part"))
    return ranged.withColumn("number", first + F.col("row")).drop("part", "row")


def with_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """sources (source, source_size, number) with weight and target. What is above most * source_size goes to the others
    by weight, in rounds, until nothing is; a round is one sum over the sources."""
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights)).cast("int"))
    sources = sources.withColumns({"weight": weight, "cap": F.col("source_size") * most})
    wanted = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        row = sources.agg(F.count_if(capped).alias("full"), F.sum(F.when(capped, F.col("cap"))).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if not row["open"]:  # all sources at their caps
            level = float("inf")
            break
        if row["full"] == full:
            break
        level, full = (wanted - (row["held"] or 0)) / row["open"], row["full"]
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)) if level != float("inf") else F.col("cap").cast("double")).drop("cap")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each document: its id, size, its source's source_size and target, taken (copies * size), copies.

    size is the number of words of the whole text, 0 for null and empty ones. Sources in code-point order, null last as a
    source of its own, weigh `weights` in turn and share `share` of all words. A document is taken target / source_size
    times, rounded up or down, and never more than `most` times; where large documents had to be rounded, the others of
    the source make up for it. A source's words come as near to its target as its last few documents allow. Null ids are
    ordered before others; rows that are equal in id, text and source are as good as each other, and each is decided; a
    very long text is a document like any other, and where it is most of its source, the source's words can miss their
    target by a part of it. A source without words has target 0, an empty table gives no rows; other columns are not
    read. The id must not have the name of a result.
    """
    if id_col in COLUMNS:
        raise ValueError(f"{id_col} is the name of a result")
    narrow = written(
        df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(id_col, text_col).alias("key")),
        "mixing",
    )
    sources = numbered(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")))
    blocks = max(1, -(-(sources.agg(F.sum("documents")).first()[0] or 0) // block_rows))
    targets = written(with_targets(sources, weights, share, most), "targets")
    large = F.col("size") * LARGE > F.col("source_size")

    def of_sources(rates: DataFrame, chosen: Column, block: Column) -> DataFrame:
        rates = rates.select(F.col("source").alias("of"), "number", "source_size", "target", "often")
        part = F.when(F.abs(F.col("often") - F.round("often")) < EPSILON, F.round("often")).otherwise(F.col("often"))
        rows = narrow.join(rates, F.col("source").eqNullSafe(F.col("of"))).where(chosen).withColumn("often", part)
        return rows.select("id", "size", "source_size", "target", F.floor("often").cast("int").alias("copies"), (F.col("often") - F.floor("often")).alias("chance"), "number", block.cast("long").alias("block"), "key")

    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b).cast("double")), F.lit(0.0))
    taken = F.col("copies") + F.col("chance").cast("int")
    decided = written(flight(of_sources(targets.withColumn("often", ratio("target", "source_size")), large, F.lit(0)), seed, -1, True), "flight").withColumn("copies", taken)
    fixed = decided.groupBy("number").agg(F.sum(F.col("copies") * F.col("size")).alias("had"), F.sum("size").alias("held"))
    rest = targets.join(fixed, "number", "left").withColumns({"left": F.col("target") - F.coalesce("had", F.lit(0)), "small": F.col("source_size") - F.coalesce("held", F.lit(0))})
    rest = written(rest.withColumn("often", F.greatest(F.lit(0.0), F.least(F.lit(float(most)), ratio("left", "small")))), "targets")
    rows, level = of_sources(rest, ~large, F.pmod("key", F.lit(blocks))), 0
    while True:
        rows = written(flight(rows, seed, level, blocks == 1), "flight")
        decided = decided.unionByName(rows.where("chance = 0 or chance = 1").withColumn("copies", taken))
        if blocks == 1:
            break
        rows = rows.where("chance > 0 and chance < 1").withColumn("block", F.floor(F.col("block") / FAN))
        blocks, level = -(-blocks // FAN), level + 1
    return decided.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
