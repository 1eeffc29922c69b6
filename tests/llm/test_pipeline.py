"""The pipeline against plain Python, stage by stage, and on odd tables."""

import collections

import public_tokenizers as P
import tiktoken
from cases import lower, no_docs, odd_docs
from pyspark.sql import functions as F
from test_similar import brute

import corpus_pipeline
from pageloom.llm import bpe, langid

SF_DIR = "/root/testdata/sf0.001"


def kept_by_exact(rows):
    keep = {}
    for r in rows:
        keep[lower(r["text"])] = max(keep.get(lower(r["text"]), -1), r["doc_id"])
    return [r for r in rows if keep[lower(r["text"])] == r["doc_id"]]


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact_copies", "near_copies", "mixture", "tokens"]
    labeller = langid.Labeller(langid.fit(docs.filter(~langid.held_out(F.col("doc_id")))))
    rows = docs.collect()
    rows = [r for r, f in zip(rows, labeller.label([r["text"] for r in rows]), strict=True) if f[0] != "und"]
    for name, want in (("language", rows), ("exact_copies", kept_by_exact(rows))):
        docs = stages[name](spark, docs, SF_DIR)
        assert docs.columns == columns
        assert collections.Counter(docs.collect()) == collections.Counter(want)
    rows = want
    groups, near = brute(rows)
    want = [r for r in rows if (r["doc_id"], r["doc_id"]) in groups]
    assert near and len(want) < len(rows)
    docs = stages["near_copies"](spark, docs, SF_DIR)
    assert collections.Counter(docs.collect()) == collections.Counter(want)
    rows, mixed = want, stages["mixture"](spark, docs, SF_DIR)
    assert mixed.columns == columns
    readings = collections.Counter(mixed.collect())
    assert set(readings) <= set(rows) and max(readings.values()) <= 3
    size = lambda r: len((r["text"] or "").encode().split())
    taken, whole = (sum(size(r) * n for r, n in x.items()) for x in (readings, collections.Counter(rows)))
    assert abs(taken - whole) <= len({r["source"] for r in rows}) * max(map(size, rows))
    with open(P.path(corpus_pipeline.VOCABULARY), "rb") as file:
        ranks = bpe.read_ranks(file.read())
    want_ids = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id = {r["doc_id"]: r["text"] for r in rows}
    for r in stages["tokens"](spark, mixed, SF_DIR).collect():
        assert r["ids"] == want_ids.encode_ordinary(by_id[r["doc_id"]]) and r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_odd_tables(spark, tmp_path):
    for name, frame in (("odd", odd_docs(spark)), ("none", no_docs(spark))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r["round_trip"] for r in rows) and (name == "odd" or rows == [])


def test_language_drops_only_what_has_none(spark):
    parts = {"en": "the dog and the cat went to the house with the dog ", "de": "der Hund und die Katze gehen in das Haus ", "ru": "это простой текст о собаке и кошке "}
    rows = [(i, parts[name] * 3, name, "s") for i, name in enumerate(list(parts) * 12)]
    rows.append((100, parts["en"] * 8 + parts["de"] * 8 + parts["ru"] * 8, None, "s"))
    docs = spark.createDataFrame([*rows, (101, "12 34", None, "s"), (102, None, None, "s")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()} == {*range(36), 100}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    found = corpus_pipeline.language(spark, bare, "").collect()
    assert {r["doc_id"] for r in found} == {*range(36), 100} and {r["lang"] for r in found} == {None}
