import json

from pyspark.sql import functions as F

from ferrule.plans import fixtures
from ferrule.streaming.findings import first_seen, report_stream


def test_reports_arrive_as_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.sarif").write_text(json.dumps(fixtures.SARIF))
    raw = report_stream(spark, str(folder)).where("problem is null").withColumn("at", F.current_timestamp())
    q = first_seen(raw, "at").select("rule_id", F.col("sink.uri").alias("uri")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
        n = spark.table("seen").count()
        (folder / "two.sarif").write_text(json.dumps(fixtures.SARIF))
        q.processAllAvailable()
        assert n == spark.table("seen").count() == 4
    finally:
        q.stop()
