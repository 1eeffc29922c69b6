import hashlib
import zlib

import numpy as np
import pytest
from cases import no_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import queries, runs

SF_DIR = "/root/testdata/sf0.001"


def brute(x, least=12):
    """Runs straight from the definition: for every period the stretches that keep it, of each the smallest period."""
    best = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


periodic = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=8)


@given(st.one_of(st.lists(st.integers(0, 2), max_size=120), periodic.map(lambda parts: [v for word, n in parts for v in word * n])))
@settings(max_examples=400, deadline=None)
def test_all_runs(x):
    assert [tuple(r) for r in runs.find_runs(np.array(x, np.int64)).tolist()] == brute(x)


def test_strings_with_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    square_at_an_odd_place = [1, 0, 1, 0, 1, 0, 0, 1, 0, 1, 0, 1] * 3
    for x in (b, square_at_an_odd_place, [0] * 1000, ([0] * 40 + [1]) * 9, list(range(20)) * 7, list(range(500))):
        assert [tuple(r) for r in runs.find_runs(np.array(x, np.int64)).tolist()] == brute(x)


@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.data())
@settings(max_examples=200, deadline=None)
def test_wavelet_tree(values, data):
    tree, lo = runs.WaveletTree(np.array(values)), data.draw(st.integers(0, len(values)))
    hi = data.draw(st.integers(lo, len(values)))
    asked = lambda v: np.array([v])
    for bound in (0, 1, 30, 61, 64, 1000):
        assert tree.count_below(asked(lo), asked(hi), asked(bound))[0] == sum(v < bound for v in values[lo:hi])
    for rank, value in enumerate(sorted(values[lo:hi])):
        assert tree.at_rank(asked(lo), asked(hi), asked(rank))[0] == value


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_odd_documents(spark):
    docs = odd_docs(spark)
    found = runs.periodic_runs(docs, keep=("doc_id", "root", "text")).collect()
    assert sorted(map(str, (r["text"] for r in found))) == sorted(map(str, (r["text"] for r in docs.collect())))
    for r in found:
        words = words_of(r["text"])
        want = brute(words[:200]) if len(words) < 200 else [(0, len(words), 3)]  # the long ones are three words again and again
        assert [tuple(x) for x in r["runs"]] == want and r["root"] == "z"
        assert r["collapsed"] == collapsed(words, want)
    assert runs.periodic_runs(no_docs(spark)).collect() == []


def want_row(doc_id, text):
    words = words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words)
    s, length, q = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return doc_id, len(found), s, length, q, 1000 * length // q if q else None, sha(lines), sha(collapsed(words, found))


@pytest.mark.parametrize("source", ["table", "odd"])
def test_query_by_brute_force(spark, tmp_path, source):
    if source == "odd":
        rows = [(i, t) for i, t in enumerate([None, "", " \n", "a", "a b " * 20, "x " * 40 + "y", "  b " * 30, *("w%d " % (i % 7) * 1 + "z " * i for i in range(60))])]
        spark.createDataFrame([*rows, (None, "a b c " * 9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    path = str(tmp_path) if source == "odd" else SF_DIR
    docs = [r for r in spark.read.parquet(f"{path}/documents.parquet").collect() if len(r["text"] or "") < 8000]
    found = {r["doc_id"]: tuple(r) for r in queries.op11_runs(spark, path).collect()}
    for r in docs:
        if r["doc_id"] is not None:
            assert found[r["doc_id"]] == want_row(r["doc_id"], r["text"])
    assert len(found) == spark.read.parquet(f"{path}/documents.parquet").count()
    if source == "odd":
        assert found[None][1:5] == (1, 0, 27, 3)
