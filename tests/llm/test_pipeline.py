import corpus_pipeline
from pyspark.sql import functions as F

from granary.llm.common import purge, table, written
from granary.llm.language_id import UNKNOWN, fit_language_model, predict_languages
from granary.llm.queries_docs import held_out
from granary.llm.queries_tokens import tokenizer_file
from granary.llm.tokens import tokenizer
from test_decontamination import brute as contaminated
from test_ngram_jaccard import brute as classes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(10_000, None, None, "x", 0), (10_001, "%% 12", None, "x", 5), (10_002, docs.first().text, "en", "x", 1)], docs.schema)
    docs = docs.unionByName(odd)
    before = {r.doc_id: r.text for r in docs.collect()}

    known = corpus_pipeline.language_id(spark, docs, SF)
    assert known.columns == docs.columns
    judged = predict_languages(docs, fit_language_model(docs, learn=~held_out())).collect()
    kept = {r.doc_id: r.text for r in known.collect()}
    assert set(kept) == {r.doc_id for r in judged if not r.rejected}
    assert {r.doc_id for r in judged if r.lang_pred == UNKNOWN} == {10_000, 10_001}
    assert len(kept) >= len(before) - 4

    unique = corpus_pipeline.near_duplicates(spark, known, SF)
    want = {c for _, c, _ in classes(list(kept.items()))}
    kept = {r.doc_id: r.text for r in unique.collect()}
    assert unique.columns == docs.columns and set(kept) == want and 10_002 not in kept

    clean = corpus_pipeline.decontamination(spark, unique, SF)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = {k for k, *_, bad in contaminated(list(kept.items()), items) if not bad}
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and set(kept) == want

    lengths = {}
    for r in corpus_pipeline.packing(spark, clean, SF).collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    library = tokenizer(tokenizer_file("byte_bpe_50k.json")).library
    assert lengths == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept.items()}


def test_run_and_purge(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "packing"]
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert purge(spark) > 0


def test_empty_tables_and_other_columns(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = table(spark, SF, "documents").limit(40).withColumn("hit", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("c0", F.lit(3)).withColumn("row", F.lit(4))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "stage")
        assert docs.columns[-4:] == ["hit", "a.b", "c0", "row"] and {tuple(r)[-4:] for r in docs.collect()} == {(1, 2, 3, 4)}
