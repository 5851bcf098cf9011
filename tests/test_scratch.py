import pytest

from tallyloom.sinks import scratch


def test_written_tables_are_read_back_and_cleared(spark):
    df = scratch.written(spark.range(5), "t")
    assert df.count() == 5 and df.dtypes == spark.range(5).dtypes
    scratch.clear(spark)
    with pytest.raises(Exception, match="exist"):
        spark.read.parquet(df.inputFiles()[0])


def test_a_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.shared_dir(Session())
