"""Plans of all registered queries of the core."""

import pytest

from granary.plans import catalogue
from granary.sources import landing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_no_nested_loops_or_products(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_what_is_stored_is_made_again_when_files_change(spark, tmp_path):
    path, made = str(tmp_path / "t"), []
    make = lambda: made.append(1) or len(made)
    spark.range(3).write.parquet(path)
    assert [landing.stored(spark, "x", [path], make) for _ in range(2)] == [1, 1]
    spark.range(4).write.mode("append").parquet(path)
    assert landing.stored(spark, "x", [path], make) == 2
    assert landing.stored(spark, "y", [path], make) == 3
    landing.purge(spark)
    assert landing.stored(spark, "x", [path], make) == 4
