"""How the test tables are dealt out."""

from checks import derived as D


def test_tasks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(D, "ROWS_PER_TASK", 100)
    cores = spark.sparkContext.defaultParallelism
    few, many = D.dealt(spark.range(99)), D.dealt(spark.range(100 * cores + 1))
    assert (few.rdd.getNumPartitions(), few.count()) == (cores, 99)
    assert (many.rdd.getNumPartitions(), many.count()) == (cores + 1, 100 * cores + 1)
