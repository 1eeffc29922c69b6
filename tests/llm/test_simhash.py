import collections
import random

import numpy as np
import xxhash
from cases import no_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import queries, simhash
from pageloom.llm.common import Steps
from pageloom.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, prints):
    """(id, smallest id reachable) by comparing everything; null ids come last."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = list(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for i, p in zip(rows, prints, strict=True):
        low[find(p)] = min(low.get(find(p), float("inf")), float("inf") if i is None else i)
    low = {k: None if v == float("inf") else v for k, v in low.items()}
    return collections.Counter((i, low[find(p)]) for i, p in zip(rows, prints, strict=True))


@given(st.text(alphabet="aBé \n\x1c\xa0c", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = queries.QUERIES["op8_simhash"](spark, "/root/testdata/sf0.001").collect()
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs}
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in found) == brute(list(prints), list(prints.values()))


def near_values(n, seed):
    """Chains of values a few bits apart, and a crowd around one value."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        value = rng.getrandbits(64)
        for _ in range(rng.choice((1, 1, 2, 6))):
            out.append(value)
            for _ in range(rng.choice((1, 2, 3))):
                value ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    for _ in range(3 * n):
        value = hub
        for _ in range(rng.choice((1, 2, 3))):
            value ^= 1 << rng.randrange(64)
        out.append(value)
    return sorted(set(out))


def test_links_connect_all_that_are_near(spark):
    """Through every choice of thresholds, with crowded buckets and without."""
    values = near_values(60, 3)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    n, both = simhash.bit_counts(prints)
    bits = np.array([[v >> (63 - i) & 1 for i in range(64)] for v in values], float)
    assert n == len(values) and (both == bits.T @ bits).all()
    plans = [simhash.plan(prints)]
    for parts, thresholds in ((2, (1, 0)), (3, (0, 0, 0)), (4, (0, -1, 0, 0)), (2, (-1, 2))):
        plans.append([simhash.Probe(tuple(b), t) for b, t in zip(simhash.group_bits(n, both, parts), thresholds, strict=True)])
    want = brute(signed, values)
    for probes in plans:
        assert sorted(b for p in probes for b in p.bits) == list(range(64))
        assert sum(p.threshold for p in probes) == 2 - len(probes) + 1
        steps = Steps(prints, "links")
        links = simhash.links(prints, probes, steps).distinct()
        assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 2 for r in links.collect())
        roots = {r["node"]: r["root"] for r in components(links, steps).collect()}
        assert collections.Counter((v, roots.get(v, v)) for v in signed) == want


def test_share_out_is_the_cheapest():
    rng = random.Random(5)
    for _ in range(50):
        costs = [{t: rng.random() if t >= 0 else 0.0 for t in (-1, 0, 1, 2)} for _ in range(3)]
        spent, chosen = simhash.share_out(costs, 0)
        every = [(sum(c[t] for c, t in zip(costs, ts, strict=True)), ts) for ts in ((a, b, -a - b) for a in (-1, 0, 1, 2) for b in (-1, 0, 1, 2)) if -1 <= ts[2] <= 2]
        assert sum(chosen) == 0 and abs(spent - min(every)[0]) < 1e-12


def test_odd_documents(spark):
    docs = odd_docs(spark)
    found = simhash.near_groups(docs, carry=("text", "_salt")).collect()
    rows = docs.collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in found) == brute([r["doc_id"] for r in rows], prints)
    kept = [r for r in found if r["kept"]]
    assert all(r["doc_id"] == r["component_id"] for r in kept) and len(kept) == len({(r["component_id"], f"{r['fingerprint']}") for r in kept})
    assert simhash.near_groups(no_docs(spark)).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Steps(spark.range(1), "cc")).collect()
    parent = {}
    for e in edges:
        for x in e:
            parent.setdefault(x, x)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in found} == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Steps(spark.range(1), "cc")).filter(F.lit(True)).collect() == []
