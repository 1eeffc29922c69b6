import collections

from cases import lower, no_docs, odd_docs

from pageloom.llm.exact import exact_groups


def brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r["text"])].append(r["doc_id"])
    keep = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return collections.Counter((r["doc_id"], keep[lower(r["text"])], len(groups[lower(r["text"])])) for r in rows)


def test_odd_documents(spark):
    docs = odd_docs(spark)
    found = exact_groups(docs, carry=("_salt", "text", "id"), first_bytes=4, growth=4).collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == brute(docs.collect())
    kept = collections.Counter(lower(r["text"]) for r in found if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({lower(r["text"]) for r in docs.collect()})
    assert {r["id"] for r in found} == {"x"}


def test_texts_that_part_late(spark):
    stem = "x" * 5000
    texts = [stem + "a", stem + "b", stem + "A", stem, stem[:64], stem[:64], "É" * 40 + "a", "É" * 40 + "A", "é" * 40 + "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = exact_groups(docs).collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == brute(docs.collect())


def test_same_ids_in_different_groups(spark):
    stem = "x" * 64
    rows = [(1, stem + "a" + "z" * 2000), (1, stem + "b" + "z" * 2000), (2, stem + "b" + "z" * 2000), (2, "y")]
    found = exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == [(1, 1, 1, True), (1, 2, 2, False), (2, 2, 1, True), (2, 2, 2, True)]


def test_no_documents(spark):
    assert exact_groups(no_docs(spark), carry=("text",)).collect() == []


def test_digits_are_successive(spark):
    """Each digit has other bytes than those before, and none is longer than asked."""
    stem = "ab" * 300
    texts = [stem, stem + "x", stem + "y", stem[:-1] + "B", stem[:100], stem[:100].upper(), stem[:101]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for first, growth, most in ((1, 2, 7), (8, 16, 1 << 18), (8, 2, 8), (700, 16, 1)):
        found = exact_groups(docs, first_bytes=first, growth=growth, most_bytes=most).collect()
        assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == brute(docs.collect())
