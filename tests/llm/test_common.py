import pytest
from pyspark.sql import functions as F

from quiverlake.llm import common


def test_bounded_rows_are_the_first_by_hash(spark):
    ids = spark.range(6000).withColumnRenamed("id", "doc_id")
    want = [r[0] for r in ids.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(150).collect()]
    for some in (ids.repartition(9), ids.coalesce(1)):
        assert [r[0] for r in common.bounded_rows(some, "doc_id", 150, 3).collect()] == want
    assert common.bounded_rows(ids.limit(20), "doc_id", 150, 3).count() == 20 and common.bounded_rows(ids.limit(0), "doc_id", 150, 3).count() == 0


def test_shares_follow_the_bytes(spark):
    docs = spark.createDataFrame([("a" * 1000,), (None,), ("é" * 500,)], "text string")
    assert common.shares(docs, per=100) == 20 and common.shares(docs) == 4 and common.shares(docs.limit(0)) == 4


def test_folders_of_a_written_table_can_go(spark):
    table = common.written(spark.range(10).withColumn("odd", F.col("id") % 2 == 1), "test", by="odd")
    rest = table.where("not odd")
    common.dropped(table, "odd=true")
    assert common.settled(rest).count() == 5


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn", "applicationId": "b"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
