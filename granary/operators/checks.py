"""The checks of an answer against its evidence, for batches of answers at once.

Claims come as columns. In a batch, the figures of all answers, claims and different evidence texts are found by one scan
each. What an evidence text may mean becomes intervals, sorted in a segment of their own for each text: a reading and its
rounding, and a reading and just the slack of doubles. Whether a figure is supported is then a binary search in a segment,
not a comparison with every reading; so it takes the logarithm of an item's length, and an item that many answers share is
read once in a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Between texts that are scanned together: no part of a number, a unit, a label or a space.
_APART = "\x00"


@dataclass(frozen=True)
class Rules:
    """What the scans look for, and the shares that claims must reach."""

    figure: re.Pattern
    scales: dict[str, float]
    bare_scales: tuple[float, ...]
    word: re.Pattern
    stem: re.Pattern
    stop: frozenset[str]
    coverage: float
    overlap: float


@dataclass(frozen=True)
class Figures:
    """Printed numbers as arrays: the text each stands in, its value and half a unit of its last digit."""

    owner: np.ndarray
    value: np.ndarray
    half: np.ndarray
    bare: np.ndarray
    unscaled: np.ndarray
    checkable: np.ndarray

    def take(self, rows: np.ndarray) -> Figures:
        return Figures(*(getattr(self, name)[rows] for name in self.__dataclass_fields__))


def scan(texts: list[str], rules: Rules) -> Figures:
    """All figures of all texts but those that a label introduces, in order."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    at, rows = [], []
    for m in rules.figure.finditer(_APART.join(t.replace(_APART, " ") for t in texts)):
        label, currency, number, unit = m.groups()
        if label is None:
            digits, name = number.replace(",", ""), (unit or "").strip().lower()
            scale, places = rules.scales.get(name, 1.0), len(digits.partition(".")[2])
            bare = not currency and not name
            at.append(m.start())
            rows.append((float(digits) * scale, 0.5 * 10.0**-places * scale, bare, name in ("", "%", "percent"), not bare or digits != number or places > 0 or len(digits) >= 5))
    columns = zip(*rows, strict=True) if rows else ((),) * 5
    value, half, *flags = (np.array(c, dtype=t) for c, t in zip(columns, (float, float, bool, bool, bool), strict=True))
    return Figures(np.searchsorted(ends, np.array(at, dtype=np.int64), "right"), value, half, *flags)


def spread_scales(figures: Figures, some: np.ndarray, scales: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(figure, value, half) of each figure as it is, and of `some` of them under every scale."""
    which = np.concatenate([np.flatnonzero(~some), *[np.flatnonzero(some)] * len(scales)])
    scale = np.concatenate([np.ones(int((~some).sum())), *[np.full(int(some.sum()), s) for s in scales]])
    return which, figures.value[which] * scale, figures.half[which] * scale


class Segments:
    """Intervals [low, high] in a segment for each owner, sorted by low, with the greatest high so far."""

    def __init__(self, owner: np.ndarray, low: np.ndarray, high: np.ndarray, owners: int):
        order = np.lexsort((low, owner))
        owner, self.low, high = owner[order], low[order], high[order]
        self.first = np.searchsorted(owner, np.arange(owners + 1))
        rank = np.unique(high, return_inverse=True)[1] if len(high) else np.zeros(0, dtype=np.int64)
        # a segment's highest rank so far: its number lifts it above all segments before it
        lifted = np.maximum.accumulate(rank + owner * (len(high) + 1)) if len(high) else rank
        values = np.sort(np.unique(high)) if len(high) else high
        self.reach = values[lifted - owner * (len(high) + 1)] if len(high) else high

    def meets(self, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether some interval of the owner meets [low, high]: of those that begin by `high`, one reaches `low`."""
        a, z = self.first[owner].copy(), self.first[owner + 1].copy()
        start = a.copy()
        while True:
            open_ = np.flatnonzero(a < z)
            if not len(open_):
                break
            mid = (a[open_] + z[open_]) >> 1
            go = self.low[mid] <= high[open_]
            a[open_[go]] = mid[go] + 1
            z[open_[~go]] = mid[~go]
        found = a > start
        out = np.zeros(len(owner), dtype=bool)
        out[found] = self.reach[a[found] - 1] >= low[found]
        return out


class Readings:
    """What the figures of some texts may mean, to be searched for other figures."""

    def __init__(self, texts: list[str], rules: Rules):
        self.rules = rules
        figures = scan(texts, rules)
        which, value, half = spread_scales(figures, figures.unscaled, rules.bare_scales)
        owner, slack = figures.owner[which], 1e-9 * np.maximum(np.abs(value), 1.0)
        self.rounded = Segments(owner, value - half - slack, value + half + slack, len(texts))
        self.exact = Segments(owner, value - slack, value + slack, len(texts))

    def support(self, figures: Figures, figure: np.ndarray, text: np.ndarray) -> np.ndarray:
        """For each figure whether one of the texts it is paired with supports it: a reading within the coarser rounding."""
        pairs = figures.take(figure)
        which, value, half = spread_scales(pairs, pairs.bare, self.rules.bare_scales)
        met = self.rounded.meets(text[which], value, value) | self.exact.meets(text[which], value - half, value + half)
        return np.bincount(figure[which[met]], minlength=len(figures.owner)) > 0


def pairs_of(owner: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, element) for each k and each element of its owner's list; a list is first[owner] and many[owner] after it."""
    n = many[owner]
    k = np.repeat(np.arange(len(owner)), n)
    return k, np.repeat(first[owner] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """First place and size of each list in the flat values of a column; null lists are empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(size) - size, size, column.flatten()


def strings(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


class Stems:
    """Content words of texts without their endings; words and texts are remembered for a batch."""

    def __init__(self, rules: Rules):
        self.rules, self.words, self.texts = rules, {}, {}

    def of(self, text: str) -> frozenset[str]:
        if text not in self.texts:
            self.texts[text] = frozenset(self._stem(w) for w in self.rules.word.findall(text.lower()) if w not in self.rules.stop)
        return self.texts[text]

    def _stem(self, word: str) -> str:
        if word not in self.words:
            self.words[word] = self.rules.stem.sub(r"\1", word)
        return self.words[word]


def failing(prose: pa.Array, claims: pa.Array, evidence: pa.Array, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each answer of a batch whether it fails the numeric, the coverage and the grounding check.

    prose: the answers' texts; claims: lists of (text, cites); evidence: lists of (kind, label, text).
    """
    rows = len(prose)
    first_claim, n_claims, claim = lists(claims)
    first_item, n_items, item = lists(evidence)
    codes = pc.fill_null(item.field("text"), "").dictionary_encode()
    readings, text_of = Readings(codes.dictionary.to_pylist(), rules), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    said = scan(strings(prose), rules)
    said = said.take(np.flatnonzero(said.checkable))
    figure, at = pairs_of(said.owner, first_item, n_items)
    numeric = np.zeros(rows, dtype=bool)
    numeric[said.owner[~readings.support(said, figure, text_of[at])]] = True

    claim_texts, claim_row = strings(claim.field("text")), np.repeat(np.arange(rows), n_claims)
    first_cite, n_cites, cite = lists(claim.field("cites"))
    own = scan(claim_texts, rules)
    own = own.take(np.flatnonzero(own.checkable))
    with_figure = np.bincount(own.owner, minlength=len(claim_texts)) > 0
    uncited = n_cites == 0
    share = 1.0 - np.bincount(claim_row[uncited], minlength=rows) / np.maximum(n_claims, 1)
    coverage = share < rules.coverage
    coverage[claim_row[uncited & with_figure]] = True

    number = pc.fill_null(cite, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cites_of = np.repeat(np.arange(len(claim_texts)), n_cites)
    valid = np.flatnonzero((number >= 1) & (number <= n_items[claim_row[cites_of]]))
    cites_of, cited = cites_of[valid], first_item[claim_row[cites_of[valid]]] + number[valid] - 1
    n_cited = np.bincount(cites_of, minlength=len(claim_texts))
    first_cited = np.cumsum(n_cited) - n_cited
    figure, at = pairs_of(own.owner, first_cited, n_cited)
    wrong = np.zeros(len(claim_texts), dtype=bool)
    wrong[own.owner[~readings.support(own, figure, text_of[cited[at]])]] = True
    wrong &= n_cited > 0

    financial = pc.fill_null(pc.equal(item.field("kind"), "financial"), False).to_numpy(zero_copy_only=False)
    words = np.bincount(cites_of[~financial[cited]], minlength=len(claim_texts)) > 0
    stems, labels, texts = Stems(rules), item.field("label"), item.field("text")
    for k in np.flatnonzero(words & ~wrong).tolist():
        mine = stems.of(claim_texts[k])
        if mine:
            there = set().union(*(stems.of(f"{labels[j].as_py() or ''} {texts[j].as_py() or ''}") for j in cited[first_cited[k] : first_cited[k] + n_cited[k]].tolist()))
            wrong[k] = len(mine & there) / len(mine) < rules.overlap
    grounding = np.zeros(rows, dtype=bool)
    grounding[claim_row[wrong]] = True
    return numeric, coverage, grounding


def checked(prose: str, claims: str, evidence: str, kept: list[str], names: list[str], rules: Rules):
    """A function of Arrow batches: the kept columns, and the three flags under `names`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = failing(batch.column(prose), batch.column(claims), batch.column(evidence), rules)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(f) for f in flags], names=names)

    return run
