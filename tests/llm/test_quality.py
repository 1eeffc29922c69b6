import collections
import re

from cases import no_docs, odd_docs
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", " ", "\n", "\t", "\x1c", "#", "é", "\xa0", "🙂"]), max_size=40).map("".join), min_size=1, max_size=30))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_counts(spark, texts):
    found = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc"]["doc_id"]: tuple(r[n] for n in NAMES) for r in found} == {i: brute(t) for i, t in enumerate(texts)}


def test_overlapping_windows(spark):
    texts = ["a b c a b c", "a a a a", "a b c d e a b c", "x y", "a b c b c a b c b"]
    found = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc"]["doc_id"]: r["n_repeat_words"] for r in found} == {0: 6, 1: 4, 2: 6, 3: 0, 4: 8} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_rules_name_what_fails(spark):
    prose = " ".join(f"the word{i} of line{i}" for i in range(40))
    texts = [prose, " ".join(f"{w}#" for w in prose.split()), " ".join(f"word{i}" for i in range(80)), "short text of the kind"]
    found = {r["doc"]["doc_id"]: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found[0]["kept"] and found[0]["failed"] == []
    assert found[1]["failed"] == ["symbols"] and found[2]["failed"] == ["stop_words"] and not found[1]["kept"]
    assert found[3]["base_failed"] and not found[3]["kept"]


def test_one_projection_without_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_odd_documents(spark):
    docs = odd_docs(spark)
    found = quality.judge(docs).select("doc.*", *NAMES, "kept").collect()
    assert len(found) == 13
    for r in found:
        assert tuple(r[n] for n in NAMES) == brute(r["text"])
    assert quality.judge(no_docs(spark)).collect() == []
    assert quality.judge(docs, rules=()).filter(F.size("failed") > 0).count() == 0
