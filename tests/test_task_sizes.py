"""What one task holds follows from constants, not from the input."""

from pyspark.sql import functions as F

from stopwise import session
from stopwise.plans import q_audit
from stopwise.sources.tables import Tables


def test_spread_bounds_the_rows_of_a_split(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    df = spark.range(0, 1000, 1, 9)
    assert session.spread(df, "id").rdd.getNumPartitions() == 100
    assert session.spread(df.limit(5), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_shuffles_start_fine_and_merge_up_to_a_bound(spark):
    session.tune(spark)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == 5 * usual
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_symmetric_difference_reads_the_grid_once(spark, monkeypatch):
    rows = [(1, 0.9, True), (1, 0.975, True), (2, 0.9, True), (2, 0.975, False), (3, 0.975, True), (3, 0.95, True), (4, 0.9, True), (4, 0.9, True)]
    table = spark.createDataFrame(rows, "traj_id long, threshold double, decided boolean")
    monkeypatch.setattr(q_audit, "grid", lambda t: table)
    found = q_audit.sym_diff(Tables(spark, "/none"))
    assert sorted(map(tuple, found.collect())) == [(2, "only_900"), (3, "only_975"), (4, "only_900"), (4, "only_900")]
    assert "Union" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where(F.col("side").isNull()).count() == 0
