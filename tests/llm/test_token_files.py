import random
import zlib

import numpy as np
import pytest

from granary.llm.queries_tokens import op9_token_files, tokenizer_file
from granary.llm.token_files import decode_blocks, encode_blocks, read_token_files, write_token_files
from granary.llm.tokens import encode

PATH = tokenizer_file("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(30))
def test_blocks_round_trip(seed):
    rnd = np.random.default_rng(seed)
    top = [1, 2, 300, 50_000, 2**31, 2**32 - 1][seed % 6]
    docs = [rnd.integers(0, top, size=rnd.choice([0, 1, 5, 127, 128, 129, 1000]), dtype=np.uint64).astype("<u4") for _ in range(rnd.integers(0, 8))]
    if docs and len(docs[0]):
        docs[0][:: 17] = 2**32 - 1  # exceptions
    data, start, blocks = encode_blocks(docs)
    assert len(start) == sum(blocks) + 1 and start[-1] == len(data)
    got = decode_blocks(data, start[:-1], np.array([len(d) for d in docs], dtype=np.int64))
    assert got.tolist() == [x for d in docs for x in d.tolist()]


def test_common_small_ids_with_outliers_pack_small():
    ids = np.array([3] * 120 + [49_000] * 8, dtype="<u4")
    assert len(encode_blocks([ids])[0]) <= 6 + 8 * 5


def brute(rows):
    out, at = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(encode(PATH, [text])[0], np.uint32(1)).astype("<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_round_trip(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k, rnd.choice(["", "Hello  World", "été " * rnd.randint(1, 400), None])) for k in range(300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int").repartition(5)
    write_token_files(df, str(tmp_path / "f"), PATH)
    got = sorted(tuple(r) for r in read_token_files(spark, str(tmp_path / "f")).collect())
    assert got == brute(rows)


def test_repeated_and_null_ids_are_whole(spark, tmp_path):
    rows = [(7, "a b")] * 50 + [(None, "c")] * 30 + [(100 + k, "d") for k in range(20)]
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), str(tmp_path / "f"), PATH, parts=8)
    got = sorted((tuple(r) for r in read_token_files(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    assert [(r[1], r[2]) for r in got] == [(r[1], r[2]) for r in brute(rows)]
    assert [r[0] for r in got] == [r[0] for r in brute(rows)]


def test_empty_table(spark, tmp_path):
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "f"), PATH)
    assert read_token_files(spark, str(tmp_path / "f")).collect() == []


def test_whole_documents_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op9_token_files(spark, "/root/testdata/sf0.001").collect()) == brute(rows)
