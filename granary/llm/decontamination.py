"""Benchmark decontamination with suffix arrays over the training documents.

Each task cuts its documents into shards. A shard is a sequence of word numbers (0: not in the test block, and between
documents) with a suffix array over all places of known words, as deep as a window. It is built by ranks: places are
ranked by their first three words, then by three such ranks, then by one word more; so it is a few arrays of integers,
whatever the length of an item. Every suffix of every test item, the short ones at an item's end too, is searched in
every shard: its neighbours in the array give a longest match of less than a window, the interval of places that start
with its window gives the hits. An interval is walked once however many suffixes share it, so items and documents that
repeat themselves cost no more than their lengths. The windows that items and documents share are numbered, and a second
suffix array over these numbers, as deep as their runs, gives the longest matches: the common prefix of a suffix with its
neighbours of the other side.

A test suffix has `window` words, or what is left of its item; only suffixes with a whole window, and items of fewer
words as a whole, count as hits.

The items go to the tasks in blocks of BLOCK_BYTES of text, one after another, so what the driver holds and broadcasts
is bounded. With several blocks the documents are written once with a row number, and each block adds the few rows it
hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from granary.llm.common import slices, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case; other letters stay as they are. Null has none."""
    return WORD.findall(text.lower()) if text else []


class TestSuffixes:
    """All suffixes of a block of benchmark items, cut at a window, as rows of word numbers."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.window, self.names = window, [name for name, _ in items]
        ids = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], dtype=np.int64) for _, text in items]
        size = np.array([len(x) for x in ids], dtype=np.int64)
        self.item = np.repeat(np.arange(len(items)), size)  # of each suffix
        first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.offset = np.arange(first[-1]) - first[self.item]  # of each suffix in its item
        left = size[self.item] - self.offset
        self.need = np.minimum(left, window)
        self.hits = (left >= window) | (self.offset == 0)  # a window, or a whole short item
        flat = np.concatenate([*ids, np.zeros(window, dtype=np.int64)])
        at = np.arange(first[-1])[:, None] + np.arange(window)
        self.rows = np.where(np.arange(window) < self.need[:, None], flat[at], 0)


class SuffixArray:
    """Sorted places of a shard's known words by the `window` words from there on; an unknown word ends a suffix."""

    def __init__(self, ids: np.ndarray, window: int = WINDOW):
        self.window = window
        padded = np.concatenate([ids.astype(np.int64), np.zeros(window, dtype=np.int64)])
        place = np.flatnonzero(ids)
        end = np.flatnonzero(padded == 0)
        known = end[np.searchsorted(end, place)] - place  # words up to the next unknown one
        full = np.zeros((len(place), window), dtype=np.int32)
        for k in range(window):
            full[:, k] = np.where(known > k, padded[place + k], 0)
        codes = self._levels(full)
        order = np.argsort(codes, kind="stable")
        self.place, self.known, self.rows, self.codes = place[order], known[order], full[order], codes[order]

    def _levels(self, rows: np.ndarray) -> np.ndarray:
        """Ranks of the rows: words are ranked by threes, the ranks by threes again, until a single one is left."""
        self.levels: list[list[np.ndarray]] = []
        columns = [rows[:, k].astype(np.int64) * 2 + 1 for k in range(rows.shape[1])]  # odd: known here
        while len(columns) > 1:
            level, out = [], []
            for k in range(0, len(columns), 3):
                found, code = _ranks(columns[k : k + 3])
                level.append(found)
                out.append(code * 2 + 1)
            self.levels.append(level)
            columns = out
        return columns[0] if columns else np.zeros(0, dtype=np.int64)

    def _search(self, rows: np.ndarray) -> np.ndarray:
        """Codes of other rows in the order of the shard's: odd and equal where a row is the shard's, else even."""
        columns = [rows[:, k].astype(np.int64) * 2 + 1 for k in range(rows.shape[1])]
        for level in self.levels:
            out = []
            for n, found in enumerate(level):
                part = columns[3 * n : 3 * n + 3]
                low = np.zeros(len(rows), dtype=np.int64)
                high = np.full(len(rows), len(found[0]), dtype=np.int64)
                for column, values in zip(part, found, strict=True):  # narrow the interval by one word after the other
                    low, high = _narrow(values, column, low, high)
                out.append(np.where(high > low, low * 2 + 1, low * 2))
            columns = out
        return columns[0]

    def intervals(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each test suffix: the first place that isn't before it, and the interval of places that start with it."""
        most = np.int64(1 << 29)
        upper = np.where(np.arange(self.window) < test.need[:, None], test.rows, most)
        at = np.searchsorted(self.codes, self._search(test.rows), "left")
        return at, at, np.searchsorted(self.codes, self._search(upper), "right")


def _ranks(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns in order, column by column, and each row's number among them."""
    order = np.lexsort(columns[::-1])
    ordered = [c[order] for c in columns]
    new = np.zeros(len(order), dtype=bool)
    for c in ordered:
        new[1:] |= c[1:] != c[:-1]
    if len(new):
        new[0] = True
    code = np.empty(len(order), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    return [c[new] for c in ordered], code


def _narrow(values: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In each interval of `values`, sorted inside it, the interval of the wanted value, by binary search."""
    def edge(after: bool) -> np.ndarray:
        a, z = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(a < z)
            if not len(open_):
                return a
            mid = (a[open_] + z[open_]) >> 1
            go = values[mid] <= wanted[open_] if after else values[mid] < wanted[open_]
            a[open_[go]] = mid[go] + 1
            z[open_[~go]] = mid[~go]

    return edge(False), edge(True)


def _common(test: TestSuffixes, array: SuffixArray, at: np.ndarray) -> np.ndarray:
    """Equal words at the start of each test suffix and of the suffix at the given index of the array; -1: no such index."""
    inside = (at >= 0) & (at < len(array.place))
    if not len(array.place):
        return np.full(len(at), -1)
    same = (array.rows[np.clip(at, 0, len(array.place) - 1)] == test.rows) & (test.rows > 0)
    return np.where(inside, np.cumprod(same, axis=1).sum(axis=1), -1)


class ShardMatches:
    """What one block of test items has in common with one shard of documents."""

    def __init__(self, test: TestSuffixes, docs: list[list[bytes]]):
        self.test, self.lengths = test, np.array([len(d) for d in docs], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        ids = np.zeros(int(self.first[-1]), dtype=np.int32)
        get = test.vocab.get
        for d, s in zip(docs, self.first, strict=False):
            ids[s : s + len(d)] = [get(w, 0) for w in d]
        self.array = SuffixArray(ids, test.window)
        self.at, self.low, self.high = self.array.intervals(test) if len(test.rows) else (np.zeros(0, np.int64),) * 3

        found = np.flatnonzero(np.where(self.test.hits, self.high - self.low, 0)) if len(self.at) else np.zeros(0, np.int64)
        key = self.low[found] * (test.window + 1) + test.need[found]
        _, one, self.number = np.unique(key, return_index=True, return_inverse=True)
        self.found, windows = found, found[one]  # suffixes that hit, and one of each different window
        n = self.high[windows] - self.low[windows]
        self.of = np.repeat(np.arange(len(windows)), n)  # the window of each hit place; the intervals hold a place once for each length
        self.place = self.array.place[np.repeat(self.low[windows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        self.need = test.need[windows][self.of]

    def mark(self, hit: list[np.ndarray], items: list[set[str]]) -> list[tuple[int, int]]:
        """Marks words of the documents in hit and adds to items; returns each document's longest match of a window or
        more as (words, place), the first of equals."""
        longest = [(0, -1)] * len(self.lengths)
        if not len(self.place):
            return longest
        size, doc = int(self.first[-1]) + 1, np.searchsorted(self.first, self.place, "right") - 1
        covered = np.cumsum(np.bincount(self.place, minlength=size) - np.bincount(self.place + self.need, minlength=size)) > 0
        sets, set_of = self._item_sets()
        for d, k in zip(*(x.tolist() for x in np.unique(np.stack([doc, set_of[self.of]]), axis=1)), strict=True):
            items[d].update(sets[k])
        words = self.need.copy()
        full = self.need == self.test.window
        if full.any():
            runs, docs = self._runs(full)
            words[full] = runs.longest(docs, runs.items)[0] + self.test.window - 1
        order = np.lexsort((self.place, -words, doc))
        for k in order[np.flatnonzero(np.diff(doc[order], prepend=-1))].tolist():
            d = int(doc[k])
            hit[d] = hit[d] | covered[self.first[d] : self.first[d] + self.lengths[d]]
            longest[d] = int(words[k]), int(self.place[k] - self.first[d])
        return longest

    def _item_sets(self) -> tuple[list[frozenset[str]], np.ndarray]:
        """The different sets of items that windows are in, and the set of each window."""
        pairs = np.unique(np.stack([self.number, self.test.item[self.found]]), axis=1)
        known: dict[bytes, int] = {}
        parts = np.split(pairs[1], np.flatnonzero(np.diff(pairs[0])) + 1)
        set_of = np.array([known.setdefault(p.tobytes(), len(known)) for p in parts])
        return [frozenset(self.test.names[k] for k in np.frombuffer(b, pairs.dtype)) for b in known], set_of

    def _runs(self, full: np.ndarray) -> tuple[WindowRuns, np.ndarray]:
        """The runs of the windows of full length, and the documents' places among them in the order of the hits."""
        which = self.test.need[self.found] == self.test.window
        place, of = self.place[full], self.of[full]
        order = np.argsort(place)
        runs = WindowRuns(self.found[which], self.number[which], self.test.item[self.found[which]], place[order], of[order])
        docs = np.empty(len(order), dtype=np.int64)
        docs[order] = runs.docs
        return runs, docs

    def of_suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """For each test suffix the words of its longest match in the shard and where the first starts (0 words: -1)."""
        before, after = _common(self.test, self.array, self.at - 1), _common(self.test, self.array, self.at)
        words = np.maximum(np.maximum(before, after), 0)
        index = np.where(after >= before, self.at, self.at - 1)
        place = np.where(words > 0, self.array.place[np.clip(index, 0, max(len(self.array.place) - 1, 0))] if len(self.array.place) else -1, -1)
        full = self.need == self.test.window
        if full.any():
            runs, _ = self._runs(full)
            which = self.found[self.test.need[self.found] == self.test.window]
            m, at = runs.longest(runs.items, runs.docs, np.sort(self.place[full]))
            words[which], place[which] = m + self.test.window - 1, at
        return words, place


class WindowRuns:
    """Runs of consecutive windows of items and of documents, sorted by the numbers of the windows from each place on.

    Ranks are doubled: by one window, by two, by four, as deep as the longest run of an item. Two places have a run of 2^k
    windows in common where their ranks of that depth are equal, so common prefixes are found by halving.
    """

    def __init__(self, item_at: np.ndarray, item_window: np.ndarray, item: np.ndarray, doc_at: np.ndarray, doc_window: np.ndarray):
        n = len(item_at) + len(doc_at)
        self.items, self.docs = np.arange(len(item_at)), np.arange(len(item_at), n)
        at = np.concatenate([item_at, doc_at])
        ends = np.ones(n, dtype=bool)
        ends[:-1] = np.diff(at) != 1
        ends[: len(item)][:-1] |= np.diff(item) != 0
        ends[len(item_at) - 1] = True
        last = np.flatnonzero(ends)
        left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1
        self.left = np.minimum(left, left[self.items].max())
        rank = np.concatenate([item_window, doc_window]).astype(np.int64) + 1
        self.levels, depth = [rank.astype(np.int32)], 1
        while depth < self.left.max():
            beyond = np.where(self.left > depth, rank[np.minimum(np.arange(n) + depth, n - 1)], 0)
            rank = np.unique(rank * (n + 1) + beyond, return_inverse=True)[1] + 1
            self.levels.append(rank.astype(np.int32))
            depth *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many windows two places have in common from there on, pair by pair."""
        a, b, room = a.copy(), b.copy(), np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            level, far = self.levels[k], len(self.left) - 1
            step = ((room - out >= 1 << k) & (level[np.minimum(a, far)] == level[np.minimum(b, far)])) << k
            a, b, out = a + step, b + step, out + step
        return out

    def longest(self, places: np.ndarray, others: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each place the most windows it has in common with one of the others, which are neighbours in the order. With
        `at`, the others' positions, also the smallest position of those that have as many in common."""
        final = self.levels[-1]
        order = np.argsort(final[others], kind="stable")
        sorted_ = others[order]
        near = np.searchsorted(final[sorted_], final[places])
        before, after = np.maximum(near - 1, 0), np.minimum(near, len(sorted_) - 1)
        first, second = self.common(places, sorted_[before]), self.common(places, sorted_[after])
        most, found = np.maximum(first, second), np.where(second >= first, after, before)
        if at is None:
            return most, found
        low, high = self._edge(places, sorted_, most, found, -1), self._edge(places, sorted_, most, found, 1)
        least, tables = at[order], [at[order]]
        while 2 << len(tables) - 1 <= len(least):  # least position of 1, 2, 4, ... neighbours
            half = 1 << len(tables) - 1
            tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
        width = high - low + 1
        k = np.array([int(w).bit_length() - 1 for w in width.tolist()], dtype=np.int64)
        out = np.empty(len(places), dtype=np.int64)
        for level in np.unique(k).tolist():
            rows = np.flatnonzero(k == level)
            out[rows] = np.minimum(tables[level][low[rows]], tables[level][high[rows] - (1 << level) + 1])
        return most, out

    def _edge(self, places: np.ndarray, sorted_: np.ndarray, most: np.ndarray, found: np.ndarray, way: int) -> np.ndarray:
        """The last neighbour from `found` on in one direction that still has `most` windows in common."""
        good, bad = found.copy(), np.full(len(found), -1 if way < 0 else len(sorted_))
        while True:
            open_ = np.flatnonzero(np.abs(bad - good) > 1)
            if not len(open_):
                return good
            mid = (good[open_] + bad[open_]) >> 1
            same = self.common(places[open_], sorted_[mid]) >= most[open_]
            good[open_[same]] = mid[same]
            bad[open_[~same]] = mid[~same]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many blocks there are, and the blocks; each comes to the driver when it is asked for."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t") + F.octet_length("i")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))

    def blocks():
        for k in range(n):
            rows = (items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)).collect()
            yield sorted((r["i"], r["t"].encode()) for r in rows)

    return n, blocks()


STATE = {"n": T.LongType(), "hit": T.BinaryType(), "items": T.ArrayType(T.StringType()), "longest": T.IntegerType(), "place": T.IntegerType()}


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns as c0, c1, ... in their order, whatever they are called, and beside them n (words), hit (bits of hit
    words), items (sorted item ids), longest and place (the longest verbatim match of a window or more in words, and where
    it first starts; 0 and -1 without one).

    Null and empty texts have no words. Items whose id or text is null, or whose text has no word, match nothing; rows of
    one item id count as one item. Repeated documents are marked each; an empty table stays empty. No shuffle while the
    benchmark is one block.
    """
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    text = f"c{docs.columns.index(text_col)}"
    names = own.columns
    n, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    share = docs.sparkSession.sparkContext.broadcast
    state = T.StructType([T.StructField(name, kind) for name, kind in STATE.items()])
    if n == 1:
        return own.mapInArrow(_pass(share(next(blocks)), own.columns, text, window, every=True), T.StructType(own.schema.fields + state.fields))
    rows = written(own.withColumn("row", F.monotonically_increasing_id()), "decontamination")
    found = None
    for items in blocks:
        packed = share(items)
        one = rows.select("row", text).mapInArrow(_pass(packed, ["row"], text, window, every=False), T.StructType([T.StructField("row", T.LongType()), *state.fields]))
        one = written(one, "hits")  # few rows; the block isn't needed from here on
        packed.destroy()
        found = one if found is None else found.unionByName(one)
    best = F.struct("longest", (-F.col("place")).alias("before"))
    found = found.groupBy("row").agg(F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max(best).alias("best"))
    joined = rows.join(found, "row", "left").select(*own.columns, "hits", "items", "best.longest", (-F.col("best.before")).alias("place"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            counts = [len(words_of(t)) for t in part.column(text).cast(pa.binary()).to_pylist()]
            hit = []
            for bits, c in zip(part.column("hits").to_pylist(), counts, strict=True):
                together = np.zeros(-(-c // 8), dtype=np.uint8)
                for b in bits or []:
                    together |= np.frombuffer(b, np.uint8)
                hit.append(together.tobytes())
            columns = [pa.array(counts, pa.int64()), pa.array(hit, pa.binary()), pa.array([x or [] for x in part.column("items").to_pylist()], pa.list_(pa.string())), part.column("longest").fill_null(0), part.column("place").fill_null(-1)]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + columns, names=[*names, *STATE])

    return joined.mapInArrow(merge, T.StructType(own.schema.fields + state.fields))


def _pass(packed, kept: list[str], text: str, window: int, every: bool):
    """Marks documents by one block of items; without `every`, rows without a hit are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TestSuffixes(packed.value, window)
        for part in slices(batches, text, 8192, SHARD_BYTES):
            docs = [words_of(t) for t in part.column(text).cast(pa.binary()).to_pylist()]
            hit, items = [np.zeros(len(d), dtype=bool) for d in docs], [set() for _ in docs]
            best = ShardMatches(test, docs).mark(hit, items)
            rows = [k for k, x in enumerate(items) if every or x]
            columns = [part.column(c) if every else part.column(c).take(pa.array(rows, pa.int64())) for c in kept]
            columns += [pa.array([len(docs[k]) for k in rows], pa.int64()), pa.array([np.packbits(hit[k]).tobytes() for k in rows], pa.binary()), pa.array([sorted(items[k]) for k in rows], pa.list_(pa.string()))]
            columns += [pa.array([best[k][i] for k in rows], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *STATE])

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, at, words, doc, place): for each suffix of each test item, from its word `at` on, the longest verbatim match
    in any document: how many words, in which document, and from which of its words on.

    Of equally long matches, the one of the smallest document id, as text, and place is taken. Suffixes without a single
    word in common have no row. item and doc are the ids as text; rows of one item id are items of their own, and the
    longest of them is returned. Tasks keep one best match for each suffix, so what is exchanged is bounded by tasks
    times suffixes. Null ids and texts take no part; empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    schema = "item string, at int, words int, doc string, place int"
    _, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    found = docs.sparkSession.createDataFrame([], schema)
    for items in blocks:
        packed = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            test = TestSuffixes(packed.value, window)
            best: dict[int, tuple[int, str, int]] = {}
            for part in slices(batches, "text", 8192, SHARD_BYTES):
                shard = ShardMatches(test, [words_of(t) for t in part.column("text").cast(pa.binary()).to_pylist()])
                if not len(test.rows):
                    continue
                words, place = shard.of_suffixes()
                names = part.column("id").to_pylist()
                for k in np.flatnonzero(words).tolist():
                    d = int(np.searchsorted(shard.first, place[k], "right")) - 1
                    one = (int(words[k]), names[d], int(place[k] - shard.first[d]))
                    if k not in best or (-one[0], one[1], one[2]) < (-best[k][0], best[k][1], best[k][2]):
                        best[k] = one
            order = sorted(best)
            yield pa.RecordBatch.from_arrays([pa.array([test.names[test.item[k]] for k in order], pa.string()), pa.array([int(test.offset[k]) for k in order], pa.int32()), pa.array([best[k][0] for k in order], pa.int32()), pa.array([best[k][1] for k in order], pa.string()), pa.array([best[k][2] for k in order], pa.int32())], names=["item", "at", "words", "doc", "place"])

        found = found.unionByName(written(rows.mapInArrow(run, schema), "longest"))
        packed.destroy()
    best = F.min(F.struct((-F.col("words")).alias("less"), "doc", "place")).alias("b")
    return found.groupBy("item", "at").agg(best).select("item", "at", (-F.col("b.less")).alias("words"), "b.doc", "b.place")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document: the id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, longest_at.

    items_sha256 is the hex digest of the sorted item ids joined by commas (of the empty string without any);
    longest_match counts words, from word longest_at of the document on (0 and -1 without a match of a window).
    """
    marked = mark(docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text"), benchmark, "text", **options).drop("c1")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean").add("longest_match", "integer").add("longest_at", "integer")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [int.from_bytes(x).bit_count() for x in b.column("hit").to_pylist()]
            items = b.column("items").to_pylist()
            columns = [b.column("c0"), b.column("n"), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([n > 0 for n in hit]), b.column("longest"), b.column("place")]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return marked.mapInArrow(digest, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a window of a benchmark item; all columns, whatever they are called, and all
    other rows stay, also null and empty texts and repeated rows; an empty table stays empty."""
    kept = mark(docs, benchmark, text_col, **options).where(F.size("items") == 0)
    return kept.select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)
