"""Visible texts of part pages over rows of its own."""

from checks.derived_queries import visible_nodes


def test_visible_nodes(spark, tmp_path):
    rows = [(1, "one", "b1", "t1", 0, 1.0), (2, "two", "b2", "t2", 8, 2.0), (2, "two", "b2", "t2", 8, 2.0), (3, None, "b3", "t3", 8, 3.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    texts = lambda k, name, maybe: [
        (k, t) for t in ("Nav " + str(k), *maybe, f"Share b{k}", f"Dialog t{k}", f"By b{k}", f"Kept t{k}", f"Shown {name}", f"Shown {name}", f"Type t{k}", f"Foot {k}")]
    found = [tuple(r) for r in visible_nodes(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(texts(1, "one", []) + 2 * texts(2, "two", ["Maybe 8"]))
