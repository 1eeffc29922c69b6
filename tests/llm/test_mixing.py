import collections

import pytest
from cases import no_docs, odd_docs
from pyspark.sql import functions as F

from pageloom.llm import mixing, queries
from pageloom.llm.common import Steps

KNOTS = "array<struct<at:double,weight:double>>"


def test_moment_inverts_the_running_area(spark):
    knots = [(0.0, 2.0), (0.25, 0.0), (0.5, 0.0), (1.0, 3.0)]
    frame = spark.createDataFrame([(knots, i / 50) for i in range(51)], f"knots {KNOTS}, share double")
    frame = frame.select("share", mixing.area(F.col("knots")).alias("area"), mixing.moment(F.col("knots"), F.col("share")).alias("at"))

    def running(at):
        total = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
            hi = min(b, at)
            if hi > a:
                total += (hi - a) * (u + u + (v - u) * (hi - a) / (b - a)) / 2
        return total

    for r in frame.collect():
        assert r["area"] == pytest.approx(1.0) and running(r["at"]) == pytest.approx(r["share"], abs=1e-9)


def test_readings_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", 1 + i % 7) for i in range(4000)], "doc_id long, source string, n long")
    schedules = spark.createDataFrame([("s0", [(0.0, 1.0), (1.0, 0.0)]), ("s1", [(0.0, 0.0), (1.0, 1.0)])], f"source string, knots {KNOTS}")
    mixed = mixing.mix(docs, schedules, F.col("n"), share=1.5)
    rows = mixed.collect()
    for s in ("s0", "s1"):
        own = [r for r in rows if r["doc"]["source"] == s]
        taken = sum(r["size"] * len(r["moments"]) for r in own)
        assert abs(taken - own[0]["target"]) <= 7 and max(len(r["moments"]) for r in own) <= 3
    read = sorted((m, r["doc"]["source"], r["size"]) for r in rows for m in r["moments"])
    early = collections.Counter()
    for m, s, n in read:
        if 0.2 <= m < 0.3:
            early[s] += n
    assert early["s0"] / sum(early.values()) == pytest.approx(0.75, abs=0.05)
    ordered = mixing.in_training_order(mixed).collect()
    assert [r["moment"] for r in ordered] == [m for m, _, _ in read]


def test_limits_share_the_excess(spark):
    sources = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 1000, 1.0), ("d", 0, 9.0)], "source string, source_size long, w double")
    sources = sources.select("source", "source_size", F.array(F.struct(F.lit(0.0).alias("at"), F.col("w").alias("weight")), F.struct(F.lit(1.0).alias("at"), F.col("w").alias("weight"))).alias("knots"))
    found = {r["source"]: r["target"] for r in mixing.targets(sources, 1110, 3.0, Steps(sources, "t")).collect()}
    assert found == {"a": 30.0, "b": 300.0, "c": 780.0, "d": 0.0}


def test_ranks(spark):
    steps = Steps(spark.range(1), "r")
    names = ["b", "a", None, "é", "Z", "𐀀", "\uffff", *(f"n{i:03}" for i in range(50))]
    found = mixing.ranked(spark.createDataFrame([(n,) for n in names], "s string"), "s", "rank", steps).collect()
    want = [*sorted((n for n in names if n is not None)), None]
    assert {r["s"]: r["rank"] for r in found} == {n: i for i, n in enumerate(want)}


def test_odd_documents(spark):
    docs = odd_docs(spark)
    mix = lambda d: mixing.mix(d, mixing.cycling_schedules(d, "source", Steps(d, "m")), mixing.word_count(F.col("text")))
    first, again = (sorted(map(str, mix(docs).select("doc.doc_id", "size", "target", "moments").collect())) for _ in range(2))
    assert first == again and len(first) == 13
    rows = mix(docs).collect()
    assert {r["doc"]["_salt"] for r in rows} == {1} and sum(r["size"] for r in rows if r["doc"]["text"] is None) == 0
    assert mix(no_docs(spark)).collect() == [] and mixing.in_training_order(mix(no_docs(spark))).collect() == []
    unknown = mixing.mix(docs, spark.createDataFrame([], f"source string, knots {KNOTS}"), F.lit(5))
    assert all(r["moments"] == [] and r["target"] == 0 for r in unknown.collect())


def test_query_goes_through_the_training_order(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mixing, "in_training_order", lambda mixed, f=mixing.in_training_order: seen.append(f(mixed)) or seen[-1])
    found = queries.QUERIES["op9_mixing"](spark, "/root/testdata/sf0.001").collect()
    [ordered] = seen
    moments = [r["moment"] for r in ordered.collect()]
    readings = collections.Counter(r["doc"]["doc_id"] for r in ordered.collect())
    assert moments == sorted(moments) and all(r["taken"] == readings[r["doc_id"]] * r["size"] for r in found)
