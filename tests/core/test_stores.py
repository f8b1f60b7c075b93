import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from granary.operators.stores import Conflict, Store

SCHEMA = T.StructType().add("k", "long").add("s", "string").add("v", "long").add("p", "double")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "t"), SCHEMA, ["k", "s"], buckets=8)
    store.upsert(spark.createDataFrame([(k, "a", k, float(k)) for k in range(200)], SCHEMA))
    return store


def test_writes_against_a_dictionary(spark, tmp_path):
    rnd, store, held = random.Random(2), Store.create(spark, str(tmp_path / "t"), SCHEMA, ["k", "s"], buckets=4), {}
    assert store.read().count() == 0 and store.version() == 0
    for _ in range(6):
        some = {(rnd.randrange(30), rnd.choice("ab")): rnd.randrange(1000) for _ in range(rnd.randint(1, 9))}
        kind = rnd.choice(["upsert", "merge", "replace", "delete"])
        df = spark.createDataFrame([(*k, v) for k, v in some.items()], "k long, s string, v long")
        if kind == "delete":
            store.delete(df)
            held = {k: v for k, v in held.items() if k not in some}
        elif kind == "merge":
            store.merge_columns(df)
            held |= {k: (v, held.get(k, (0, None))[1]) for k, v in some.items()}
        else:
            getattr(store, kind)(df.withColumn("p", F.lit(0.5)))
            held |= {k: (v, 0.5) for k, v in some.items()}
        assert rows(store.read()) == sorted(((*k, *v) for k, v in held.items()), key=repr), kind


def test_untouched_files_keep_their_names_and_old_versions_stay(spark, store):
    before, old = files(store.path), rows(store.read())
    assert store.upsert(spark.createDataFrame([(5, "a", -5, 0.0), (5, "a", -6, 0.0)], SCHEMA), latest="v") == 2
    named = lambda v: set(store._manifest(v).values())
    assert before <= files(store.path) and len(named(1) - named(2)) == 1  # one bucket of eight
    assert rows(store.read(1)) == old and rows(store.read()) == sorted([r for r in old if r[0] != 5] + [(5, "a", -5, 0.0)], key=repr)
    assert store.vacuum() == 1 and len(rows(store.read())) == 200


def test_a_failed_write_leaves_the_old_table(spark, store):
    old = rows(store.read())
    broken = spark.createDataFrame([(7, "a", 1, 1.0)], SCHEMA).withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="no"):
        store.upsert(broken)
    with pytest.raises(ValueError):
        store.write(spark.createDataFrame([(7, "a", 1, 1.0)], SCHEMA), lambda old, new: new.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long")))))
    assert store.version() == 1 and rows(store.read()) == old
    assert store.upsert(spark.createDataFrame([], SCHEMA)) == 1


def test_a_second_writer_notices(spark, store):
    one, two = Store(spark, store.path), Store(spark, store.path)
    seen = two.version()
    one.delete(spark.createDataFrame([(1, "a")], "k long, s string"), base=seen)
    with pytest.raises(Conflict):
        two.upsert(spark.createDataFrame([(1, "a", 9, 9.0)], SCHEMA), base=seen)
    assert two.upsert(spark.createDataFrame([(1, "a", 9, 9.0)], SCHEMA)) == 3
    with pytest.raises(FileExistsError):
        Store.create(spark, store.path, SCHEMA, ["k"])
    with pytest.raises(ValueError):
        Store.create(spark, store.path + "2", SCHEMA, ["none"])


def test_null_keys_are_only_added(spark, store):
    store.upsert(spark.createDataFrame([(None, "a", 1, 1.0)], SCHEMA))
    store.upsert(spark.createDataFrame([(None, "a", 2, 1.0)], SCHEMA))
    assert sorted(r.v for r in store.read().where("k is null").collect()) == [1, 2]


def test_after_a_writer_died_vacuum_lets_others_go_on(spark, store):
    open(f"{store.path}/versions/_claim-2", "w").close()
    new = spark.createDataFrame([(1, "a", 9, 9.0)], SCHEMA)
    with pytest.raises(Conflict):
        store.upsert(new)
    store.vacuum()
    assert store.upsert(new) == 2 and store.read().where("k = 1").first().v == 9
