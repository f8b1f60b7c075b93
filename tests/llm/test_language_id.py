import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm.language_id import MARGIN, LanguageModel, Predictor, calibrate, fit_language_model, in_unseen_letters, keep_known_languages, predict_languages, softmax, subwords, words_of
from granary.llm.queries_docs import held_out, op4_language_id

SYLLABLES = {"aa": ["ba", "na", "ta", "ka"], "bb": ["eux", "ille", "eau"], "cc": ["sch", "ung", "keit"]}


def corpus(n, seed=0):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rnd.choice(list(SYLLABLES))
        words = ["".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 40))]
        rows.append((k, " ".join(words), lang, 9.0))
    return rows


def test_learns_rejects_and_keeps(spark):
    docs = spark.createDataFrame(corpus(400), "doc_id long, text string, lang string, score double").repartition(3)
    model = fit_language_model(docs, learn=F.col("doc_id") % 4 != 0)
    assert model.languages == ["aa", "bb", "cc"]
    rows = predict_languages(docs, model).join(docs.drop("score"), "doc_id").where("doc_id % 4 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in rows) == len(rows) == 100
    assert all(0 <= r.score <= 1 and not r.rejected for r in rows)
    odd = [(1, None), (2, ""), (3, "123 ²½ _ !?"), (4, "Привет как дела"), (5, "naka BATA"), (None, "eaueux"), (5, "naka BATA")]
    df = spark.createDataFrame([(*x, None, 1.0) for x in odd], "doc_id long, text string, lang string, score double").coalesce(1)
    assert [(r.lang_pred, r.rejected) for r in predict_languages(df, model).collect()] == [("und", True)] * 3 + [(Predictor(model).predict(["Привет как дела"])[0][0], True)] + [("aa", False), ("bb", False), ("aa", False)]
    kept = keep_known_languages(df, model)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [5, None, 5]


def test_predictions_against_sums_over_subwords_one_by_one(spark):
    docs = spark.createDataFrame(corpus(200), "doc_id long, text string, lang string, score double")
    model = fit_language_model(docs)
    texts = ["naka bata eaueux", "schung x", "eau " * 500 + "ta", "Keit-KEIT 7 kéit", "naka bata eaueux"]
    for text, (lang, score, rejected) in zip(texts, Predictor(model).predict(texts), strict=True):
        total, n = [0.0] * len(model.languages), 0
        for word in words_of(text):
            for bucket in subwords(word):
                n += 1
                for k in range(len(total)):
                    total[k] += float(model.scores[bucket][k])
        odds = [math.exp(t / n * model.scale) for t in total]
        best = max(range(len(odds)), key=lambda k: odds[k])
        assert lang == model.languages[best] and score == pytest.approx(odds[best] / sum(odds), rel=1e-9)
        assert rejected == (score < model.threshold)


def test_without_labels_and_on_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = fit_language_model(docs)
    assert [tuple(r) for r in predict_languages(docs, model).collect()] == [(1, "und", 0.0, True), (2, "und", 0.0, True)]
    assert predict_languages(docs.limit(0), model).collect() == []


def test_scores_are_calibrated_and_other_languages_rejected(spark):
    """On held-out rows, the mean score of a bin of scores lies near its share of right answers."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_language_model(docs, learn=~held_out())
    rows = predict_languages(docs.where(held_out()), model).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred != 'und'").collect()
    bins = {}
    for r in rows:
        bins.setdefault(min(int(r.score * 10), 9), []).append((r.score, r.lang == r.lang_pred))
    error = sum(abs(sum(s for s, _ in b) - sum(ok for _, ok in b)) for b in bins.values()) / len(rows)
    assert len(rows) > 150 and error < 0.04
    assert 1 / len(model.languages) < model.threshold < 0.9
    foreign = ["Привет как дела, очень хорошо", "Γειά σου κόσμε τι κάνεις", "これは日本語の文章です", "مرحبا بالعالم كيف حالك"]
    found = Predictor(model).predict([in_unseen_letters(r.text) for r in docs.where("text is not null").limit(200).collect()])
    assert all(x[2] for x in Predictor(model).predict(foreign)) and sum(x[2] for x in found) / len(found) > 0.97


def test_the_threshold_comes_from_held_out_scores():
    scores = np.zeros((4, 2), dtype=np.float32)
    scores[0], scores[1] = (1, -1), (-1, 1)
    one = lambda bucket, n=1: (np.array([bucket]), np.array([n]))
    model = LanguageModel(["a", "b"], scores, 1.0, 0.0)
    labels = np.array([0, 1] * 20)
    calibrate(model, [one(int(k)) for k in labels], labels, [one(3)] * 40)
    sure = float(softmax(np.array([[1.0, -1.0]]) * model.scale).max())
    assert sure > 0.95 and model.threshold == pytest.approx(0.5 + MARGIN * (sure - 0.5))  # unseen letters have even odds here
    calibrate(model, [one(int(k)) for k in labels], labels, [one(0)] * 40)
    assert model.threshold == pytest.approx(float(softmax(np.array([[1.0, -1.0]]) * model.scale).max()))  # no right answer goes


def test_rows_without_ids_teach_too(spark):
    docs = spark.createDataFrame([(None, t, lang) for _, t, lang, _ in corpus(300)], "doc_id long, text string, lang string")
    assert fit_language_model(docs, sample=200).languages == ["aa", "bb", "cc"]


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "naka taba", "x", 2), (2, None, "y", 3)], "`a.b` int, text string, text2 string, rejected int")
    model = fit_language_model(spark.createDataFrame(corpus(200), "doc_id long, text string, lang string, score double"))
    kept = keep_known_languages(docs, model)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "naka taba", "x", 2)]


def test_words():
    assert words_of("Ab c²d 12 ½ É_x") == ["ab", "c²d", "é", "x"]


def test_held_out_accuracy_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = op4_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert sum(r.rejected for r in rows) / len(rows) < 0.02
