import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import no_docs, odd_docs
from pyspark.sql import functions as F

from pageloom.llm import digest, queries

SF_DIR = "/root/testdata/sf0.001"


def texts_of(docs):
    return [(r["text"] or "").encode() for r in docs.collect()]


def slow_level(window):
    return (6 - sum(n * math.log2(n) for n in Counter(window).values()) / 64) / 6 * 1000


def slow_digest(text, ranks):
    """Features and filters from the definition, a window at a time."""
    n = len(text) - 63
    rank = [int(ranks[x]) for x in digest.entropy_levels(np.frombuffer(text, np.uint8))]
    points = [0] * max(n, 0)
    for i in range(n):
        best = min(range(i, min(n, i + 64)), key=lambda j: (rank[j], j))
        points[best] += rank[best] != digest.NEVER
    need = min(16, max(points, default=0))
    features = [int(digest._hashes(np.frombuffer(text, np.uint8), np.array([i]))[0]) for i in range(max(n, 0)) if need and points[i] >= need]
    features = list(dict.fromkeys(features)) or ([xxhash.xxh64_intdigest(text)] if text else [])
    bits = np.zeros((-(-len(features) // 160), 2048), bool)
    for k, h in enumerate(features):
        for j in range(5):
            bits[k // 160, h >> 11 * j & 2047] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def test_levels(spark):
    data = b" ".join(texts_of(spark.read.parquet(f"{SF_DIR}/documents.parquet"))[:30]) + b"a" * 200 + bytes(range(256))
    found = digest.entropy_levels(np.frombuffer(data, np.uint8))
    for i in [*range(200), *range(digest.BLOCK - 100, min(digest.BLOCK + 100, len(found))), *range(len(found) - 500, len(found))]:
        assert found[i] <= slow_level(data[i : i + 64]) + 1e-3 < found[i] + 1.01
    assert found[-200 - 256 - 63 + 200] >= 0 and found[-1] == 1000


def test_digests_by_brute_force(spark):
    texts = texts_of(spark.read.parquet(f"{SF_DIR}/documents.parquet"))[:60] + [b"", b"abc", b"a" * 500, b"x" * 64, bytes(range(64)), b"ab" * 40 + bytes(range(90))]
    texts.append(b" ".join(texts))
    ranks = digest.ranks_of(sum(digest.level_counts([t]) for t in texts))
    assert (digest.level_counts(texts) == sum(digest.level_counts([t]) for t in texts)).all()
    for text, found in zip(texts, digest.digests(texts, ranks), strict=True):
        assert np.array_equal(found, slow_digest(text, ranks))
        assert np.array_equal(digest.unpacked(digest.packed(found)), found)


def test_likeness(spark):
    texts = [t for t in texts_of(spark.read.parquet(f"{SF_DIR}/documents.parquet")) if len(t) > 1500][:40]
    ranks = digest.ranks_of(digest.level_counts(texts))
    made = digest.digests([*texts, *(t[: len(t) * 3 // 4] + u[: len(t) // 4] for t, u in zip(texts, reversed(texts), strict=True))], ranks)
    own = [digest.likeness(a, b) for a, b in zip(made, made[len(texts):], strict=False)]
    assert min(own) > 0.3 and np.mean(own) > 0.55
    for a in made[:10]:
        for b in made[:10]:
            assert digest.likeness(a, b) == digest.likeness(b, a) and 0 <= digest.likeness(a, b) <= 1
            assert (digest.likeness(a, b) == 1) == (a is b)
    none = np.empty((0, 32), np.uint64)
    assert digest.likeness(none, none) == 1 and digest.likeness(none, made[0]) == 0


def want(rows, ranks):
    """The result in order of the ids; rows: (id, text)."""
    hashed = lambda t: xxhash.xxh64(t.encode(), 42).intdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(hashed(r[1]))))
    made = [slow_digest(t.encode(), ranks) for _, t in rows]
    out = []
    for k, (i, text) in enumerate(rows):
        after = (k + 1) % len(rows)
        half = len(text) // 2
        copy = text[: len(text) - half] + rows[after][1][:half]
        other = slow_digest(copy.encode(), ranks)
        out.append((i, len(text), hashlib.sha256(copy.encode()).hexdigest(), digest.packed(made[k]), digest.packed(other),
                    digest.likeness(made[k], other), digest.likeness(made[k], made[after])))
    return Counter(out)


@pytest.mark.parametrize(("least", "most"), [(256, 1 << 16), (3, 8), (1, 1 << 16)])
def test_query_by_brute_force(spark, monkeypatch, least, most):
    monkeypatch.setattr(digest, "LEAST_PART", least)
    monkeypatch.setattr(digest, "MOST_PARTS", most)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter(F.length("text") < 4000)
    ranks = digest.rarity(docs)
    found = [tuple(r) for r in digest.against_edits(docs).collect()]
    assert Counter(found) == want([(r["doc_id"], r["text"]) for r in docs.collect()], ranks)


def test_the_query(spark):
    found = queries.op13_digest(spark, SF_DIR).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    by_text = {}
    for r in found:
        text = docs[r["doc_id"]]
        copy = digest.edited(text, docs[after[r["doc_id"]]])
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(copy.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == digest.likeness(digest.unpacked(r["fingerprint"]), digest.unpacked(r["edited_fingerprint"]))
    longer = [r for r in found if r["n_chars"] > 1000]
    assert np.mean([r["near_edited"] > r["near_next"] for r in longer]) > 0.95


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(digest, "LEAST_PART", 2)
    docs = odd_docs(spark)
    small = docs.filter("text is null or length(text) < 1000")
    ranks = digest.rarity(small)
    assert Counter(tuple(r) for r in digest.against_edits(small).collect()) == want([(r["doc_id"], r["text"]) for r in small.collect()], ranks)
    assert len(digest.against_edits(docs).collect()) == docs.count()
    assert digest.against_edits(no_docs(spark)).collect() == []
    one = digest.against_edits(docs.filter("doc_id = 2")).collect()
    assert [(r["near_next"], r["n_chars"]) for r in one] == [(1.0, 23)]
    made = digest.with_likeness(digest.with_digests(docs, ranks, keep=("doc_id", "text", "root")).withColumn("b", F.col("fingerprint")), "fingerprint", "b").collect()
    assert {r["likeness"] for r in made} == {1.0} and len(made) == docs.count()
