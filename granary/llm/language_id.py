"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A word's subwords are its character n-grams of 2 to 4 letters with word-end marks, and the word itself, hashed to
BUCKETS rows of an embedding. A text is the average over all subwords of all its words. There is no bias term and
classes weigh the same, so a text of unknown subwords gets an even distribution: that is what rejection relies on.

The model is fitted on a bounded sample of labelled rows (SAMPLE of them, by a hash of the id and the text), a fifth of
which calibrates and isn't learned from. A temperature is fitted to it by likelihood, with Platt's targets, which keep the
temperature finite where languages are separated without an error. The threshold of rejection is found between two sets
of scores: those of its right answers, and those of the same texts in letters of a script that stands in no training
text. It lies MARGIN of the way from the score that UNSEEN of the latter stay below to the one that only REJECT of the
former fall below, nearer to the latter as a text that is kept in error costs less than one that is lost; where the two
overlap, right answers come first.
Prediction is linear in subword counts, so each word's sum of class scores is computed once and cached.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from granary.llm.common import slices

BUCKETS, WIDTH = 1 << 14, 16
SAMPLE, REJECT, UNSEEN, UNKNOWN = 4000, 0.001, 0.999, "und"
HELD, MARGIN = 5, 0.25
CACHE_ENTRIES = 100_000
#: Bytes of text that are cut into words at a time.
SLICE_BYTES = 1 << 20
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case. A run counts only if it holds a letter in Unicode's sense."""
    return [w for w in _RUN.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def subwords(word: str) -> list[int]:
    marked = f"<{word}>"
    return [zlib.crc32(marked[k : k + n].encode()) % BUCKETS for n in (2, 3, 4) for k in range(len(marked) - n + 1)] + [zlib.crc32(marked.encode()) % BUCKETS]


def subword_counts(text: str | None, cache: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text."""
    parts = []
    for w in words_of(text):
        if w not in cache:
            cache[w] = np.array(subwords(w), dtype=np.int32)
        parts.append(cache[w])
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 12, batch: int = 64, rate: float = 40.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Embedding and class weights by minibatch SGD with a linearly falling rate."""
    rnd = np.random.default_rng(seed)
    embed = rnd.normal(0, 1e-3, (BUCKETS, WIDTH)).astype(np.float32)
    weight = rnd.normal(0, 1.0, (WIDTH, classes)).astype(np.float32)
    share = len(labels) / (classes * np.maximum(np.bincount(labels, minlength=classes), 1))
    steps, step = epochs * -(-len(samples) // batch), 0
    for _ in range(epochs):
        order = rnd.permutation(len(samples))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
            for k, r in enumerate(rows):
                index, count = samples[r]
                x[k, index] = count / count.sum()
            mean = x @ embed
            slope = softmax(mean @ weight)
            slope[np.arange(len(rows)), labels[rows]] -= 1
            slope *= (share[labels[rows]] / len(rows))[:, None]
            lr = rate * (1 - step / steps)
            touched = np.flatnonzero(x.any(axis=0))
            embed[touched] -= lr * (x[:, touched].T @ (slope @ weight.T))
            weight -= 0.01 * lr * (mean.T @ slope)
            step += 1
    return embed, weight


@dataclass
class LanguageModel:
    """languages: sorted; scores: class scores of each bucket; a text's logits are their average times scale."""

    languages: list[str]
    scores: np.ndarray
    scale: float
    threshold: float

    def logits(self, samples: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([(self.scores[i] * c[:, None]).sum(axis=0) / c.sum() for i, c in samples])


def in_unseen_letters(text: str | None) -> str:
    """The text with its letters replaced, one by one, by ideographs: words of the same lengths and repeats in a script
    that the training texts are taken not to have."""
    return "".join(chr(0x4E00 + ord(c) * 7919 % 20000) if c.isalpha() else c for c in (text or "").lower())


def calibrate(model: LanguageModel, samples: list, labels: np.ndarray, unseen: list, reject: float = REJECT, catch: float = UNSEEN) -> None:
    """Fits the temperature and the threshold of rejection; unseen: the samples in letters that weren't learned."""
    logits = model.logits(samples)
    right, n = np.arange(len(labels)), len(labels)
    target = np.full(logits.shape, 1 / (n + 2) / max(logits.shape[1] - 1, 1))
    target[right, labels] = (n + 1) / (n + 2)

    def loss(scale: float) -> float:
        return -(target * np.log(softmax(logits * scale) + 1e-12)).sum()

    model.scale = float(min(np.geomspace(0.02, 50, 201), key=loss))
    p = softmax(logits * model.scale)
    sure = p.max(axis=1)[p.argmax(axis=1) == labels]
    unsure = softmax(model.logits(unseen) * model.scale).max(axis=1) if unseen else np.zeros(0)
    allowed = np.quantile(sure, reject) if len(sure) else 0.0
    needed = np.quantile(unsure, catch) if len(unsure) else 0.0
    model.threshold = float(min(allowed, needed + MARGIN * (allowed - needed)))


def fit_language_model(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, reject: float = REJECT, seed: int = 0) -> LanguageModel:
    """Fits on rows with a language, a text and `learn` true. Without any, every text will be unknown.

    The sample holds at most 2 * sample rows, in expectation `sample`, spread evenly over all labelled rows by a hash of
    id and text. Null ids are no hindrance; rows that are equal in both are drawn together. Texts without a letter teach
    nothing. With fewer than 50 rows, all of them teach and calibrate.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.lit(True) if learn is None else learn).alias("learn"))
    labelled = labelled.where("lang is not null and text is not null and learn")
    n = labelled.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(1 << 40))
    rows = labelled.where(draw < int((1 << 40) * min(1.0, sample / max(n, 1)))).select(draw.alias("draw"), "lang", "text").limit(2 * sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        for part in slices(batches, "text", max_bytes=SLICE_BYTES):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            texts, draws = part.column("text").to_pylist(), part.column("draw").to_pylist()
            got = [subword_counts(t, cache) for t in texts]
            other = [subword_counts(in_unseen_letters(t), {}) if d % HELD == 0 or n < 50 else ([], []) for t, d in zip(texts, draws, strict=True)]
            columns = [pa.array([np.asarray(x[k], dtype=np.int32) for x in side], pa.list_(pa.int32())) for side in (got, other) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("draw"), part.column("lang"), *columns], names=["draw", "lang", "index", "count", "other", "others"])

    table = rows.mapInArrow(features, "draw long, lang string, index array<int>, count array<int>, other array<int>, others array<int>").toArrow()
    found = sorted(((r[0], r[1], *map(np.array, r[2:])) for r in zip(*(table.column(k).to_numpy(zero_copy_only=False) for k in range(6)), strict=True) if len(r[2])), key=lambda r: (r[0], r[1], len(r[2])))
    languages = sorted({r[1] for r in found})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), 1.0, 0.0)
    number = {lang: k for k, lang in enumerate(languages)}
    samples, labels = [(r[2], r[3]) for r in found], np.array([number[r[1]] for r in found])
    held = np.array([r[0] % HELD == 0 for r in found])
    fit = ~held
    if n < 50 or not held.any() or not fit.any():
        held = fit = np.ones(len(found), dtype=bool)
    embed, weight = train([s for s, f in zip(samples, fit, strict=True) if f], labels[fit], len(languages), seed=seed)
    model = LanguageModel(languages, embed @ weight, 1.0, 0.0)
    calibrate(model, [s for s, h in zip(samples, held, strict=True) if h], labels[held], [(r[4], r[5]) for r, h in zip(found, held, strict=True) if h and len(r[4])], reject)
    return model


class Predictor:
    """Scores whole texts with a cache of each word's class scores."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages) + 1), dtype=np.float64)

    def _learn(self, words: list[str]) -> None:
        need = len(self.number) + len(words)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need - len(self.table), len(self.table)), self.table.shape[1]))])
        grams = [subwords(w) for w in words]
        sizes = np.array([len(g) for g in grams])
        sums = np.add.reduceat(self.model.scores[np.concatenate(grams)].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        at = len(self.number)
        self.table[at : at + len(words), :-1], self.table[at : at + len(words), -1] = sums, sizes
        self.number.update(zip(words, range(at, at + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, calibrated probability, rejected); texts without a letter, and nulls, are unknown with 0."""
        if len(self.number) > CACHE_ENTRIES:
            self.forget()
        cut = [words_of(t) for t in texts]
        if not self.model.languages:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        if new := [w for w in dict.fromkeys(w for words in cut for w in words) if w not in self.number]:
            self._learn(new)
        out = []
        for words in cut:
            if not words:
                out.append((UNKNOWN, 0.0, True))
                continue
            total = self.table[np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
            p = softmax((total[:-1] / total[-1] * self.model.scale)[None])[0]
            best = int(p.argmax())
            out.append((self.model.languages[best], float(p[best]), bool(p[best] < self.model.threshold)))
        return out


def _predictions(df: DataFrame, model: LanguageModel, text_col: str, schema: T.StructType, rows) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for part in slices(batches, text_col, max_bytes=SLICE_BYTES):
            yield rows(part, predictor.predict(part.column(text_col).to_pylist()))

    return df.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: the id, lang_pred, score (0 to 1) and rejected. Only the text is looked at.

    lang_pred is und, with score 0 and rejected, where the text is null or has no letter. Repeated rows are judged
    each; an empty table gives no rows; other columns are not read.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def rows(part, found):
        return pa.RecordBatch.from_arrays([part.column("__id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], names=schema.names)

    return _predictions(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), model, "__text", schema, rows)


def keep_known_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; columns, whatever they are called, and other rows stay as they are.

    Rejected are texts that are null or have no letter, and those whose probability is below the model's threshold.
    Repeated rows are judged each; an empty table stays empty.
    """
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    kept = _predictions(own, model, f"c{docs.columns.index(text_col)}", own.schema, lambda part, found: part.filter(pa.array([not x[2] for x in found], pa.bool_())))
    return kept.toDF(*docs.columns)
