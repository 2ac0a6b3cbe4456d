import pytest

from sessionloom.sources import cached
from tests.conftest import rows


def test_hit_miss_changed_input_and_broken_build(spark, tmp_path):
    inputs, folder = str(tmp_path / "in"), str(tmp_path / "tables")
    spark.range(3).write.parquet(inputs)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(inputs).selectExpr("id + 1 AS id")

    def get(**parameters):
        return cached.cached_table(spark, folder, [inputs], parameters, build)

    assert rows(get(k=1)) == rows(get(k=1)) == [(1,), (2,), (3,)]
    assert len(built) == 1
    get(k=2)
    assert len(built) == 2  # other parameters
    spark.range(5).write.mode("overwrite").parquet(inputs)
    fresh = get(k=1)
    assert fresh.count() == 5 and len(built) == 3  # other files

    def broken():
        return spark.read.parquet(inputs).selectExpr("raise_error('no') AS id")

    with pytest.raises(Exception, match="no"):
        cached.cached_table(spark, folder, [inputs], {"k": 3}, broken)
    assert not [p for p in (tmp_path / "tables").iterdir() if p.name.startswith(".")]
    assert get(k=3).count() == 5 and len(built) == 4  # nothing of the broken build is read

    cached.drop_others(spark, folder, fresh)
    assert len(list((tmp_path / "tables").iterdir())) == 1
    assert get(k=1).count() == 5 and len(built) == 4


def test_a_second_builder_reads_the_first_ones_table(spark, tmp_path):
    folder = str(tmp_path / "tables")
    spark.range(1).write.parquet(str(tmp_path / "in"))

    def slow():
        first = cached.cached_table(spark, folder, [str(tmp_path / "in")], {}, lambda: spark.range(7))
        assert first.count() == 7
        return spark.range(8)

    assert cached.cached_table(spark, folder, [str(tmp_path / "in")], {}, slow).count() == 7
    assert len(list((tmp_path / "tables").iterdir())) == 1
