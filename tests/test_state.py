from pyspark.sql import SparkSession

from ferrule.plans import state


def test_tables_between_rounds(spark: SparkSession, monkeypatch, tmp_path):
    monkeypatch.setattr(state, "folder", lambda s: f"file://{tmp_path}/t")
    df = state.kept(spark.range(5), "numbers")
    assert df.count() == 5 and list((tmp_path / "t").iterdir())
    state.clean(spark)
    assert not (tmp_path / "t").exists()
    state.clean(spark)
