"""Near-duplicates by SimHash fingerprints, joined with the generalised pigeonhole principle.

The 64 bits are grouped into partitions so that correlated bits stand together. Two fingerprints
within `distance` bits agree within t_i bits on some partition i whenever the thresholds t_i sum
to distance - m + 1. How the m partitions share that sum is chosen by dynamic programming on the
candidate counts estimated from all fingerprints; -1 leaves a partition out. Members of a bucket
are verified pair by pair. Where a bucket is large, its members are linked instead through the
values one bit away from them: two fingerprints are within two bits exactly when they share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Steps, attach, look_up
from pageloom.llm.components import components

BITS = 64
# Members of a bucket that are still compared pair by pair.
SMALL_BUCKET = 32
# Numbers of partitions tried.
PARTITIONS = (2, 3, 4)
# Shingles hashed at a time, which bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, A-Z lower-cased; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    width = min(shingle, len(words))
    n, ones, digest = len(words) - width + 1, np.zeros(BITS, np.int64), xxhash.xxh64_digest
    for lo in range(0, n, BLOCK):
        part = words[lo : min(lo + BLOCK, n) + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        raw = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc: a struct of the row, fp: its fingerprint as a signed long); null and blank texts get 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc", "fp"])

    rows = docs.select(F.struct(*(c for c in docs.columns if c != text)).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, fp long")


# --- Bit statistics and partitions

def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them bits i and j are both set (64 x 64)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            for lo in range(0, len(values), BLOCK):
                bits = np.unpackbits(np.frombuffer(values[lo : lo + BLOCK].tobytes(), np.uint8).reshape(-1, 8), axis=1)
                both += bits.T.astype(np.float64) @ bits
                n += len(bits)
        counts = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts)], ["cell", "n"])

    rows = prints.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)  # a fixed number of cells, whatever the input
    for row in rows:
        cells[row["cell"]] = row["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Positions (0 is the highest bit) in `parts` groups of nearly equal size, correlated ones together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(p * (1 - p))
    scale = np.outer(spread, spread)
    with np.errstate(divide="ignore", invalid="ignore"):
        like = np.where(scale > 0, np.abs(both / max(n, 1) - np.outer(p, p)) / scale, 0)
    np.fill_diagonal(like, -1)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - g)
        left = sorted(free)
        first = left[int(np.argmax(like[np.ix_(left, left)].max(axis=1)))]
        group = [first]
        free.remove(first)
        while len(group) < size:
            nearest = max(sorted(free), key=lambda b: like[b, group].mean())
            group.append(nearest)
            free.remove(nearest)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


@dataclass(frozen=True)
class Probe:
    """A partition's bits and the threshold it was given."""

    bits: tuple[int, ...]
    threshold: int


def share_out(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds, one per partition, that sum to `total`: `costs[i][t]` is the cost of t on i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for so_far, (spent, chosen) in best.items():
            for t, c in cost.items():
                if so_far + t not in step or spent + c < step[so_far + t][0]:
                    step[so_far + t] = (spent + c, [*chosen, t])
        best = step
    return best[total]


def plan(prints: DataFrame, distance: int = 2) -> list[Probe]:
    """Partitions and thresholds with the least estimated work for joining `prints` (fp) with themselves.

    Work is the rows written to buckets plus the candidates met there. Pairs that agree on a
    partition are counted over all fingerprints; those some bits apart are estimated from them and
    from how often each bit differs.
    """
    n, both = bit_counts(prints)
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    odds = differ / (1 - differ)
    choices = {m: group_bits(n, both, m) for m in PARTITIONS}
    cells = [(m, i, mask_of(bits)) for m, groups in choices.items() for i, bits in enumerate(groups)]
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("cell"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key"))
                               for k, (_, _, mask) in enumerate(cells))))
    sizes = prints.select(keys.alias("k")).groupBy("k.cell", "k.key").agg(F.count(F.lit(1)).alias("c"))
    met = F.least(F.col("c") * (F.col("c") - 1) / 2, F.col("c") * (BITS + 1.0))
    equal = {r["cell"]: float(r["met"]) for r in sizes.groupBy("cell").agg(F.sum(met).alias("met")).collect()}
    plans = []
    for m, groups in choices.items():
        costs = []
        for i, bits in enumerate(groups):
            at = equal.get(cells.index((m, i, mask_of(bits))), 0.0)
            one = float(odds[bits].sum())
            two = (one**2 - float((odds[bits] ** 2).sum())) / 2
            near = (1 + len(bits)) * n
            costs.append({-1: 0.0, 0: n + at, 1: near + at * (1 + one), 2: near + at * (1 + one + two)})
        spent, thresholds = share_out(costs, distance - m + 1)
        plans.append((spent, [Probe(tuple(b), t) for b, t in zip(groups, thresholds, strict=True)]))
    return min(plans, key=lambda found: found[0])[1]


# --- Links

def _around(value: Column, bits: list[int]) -> list[Column]:
    """`value` with each of `bits` flipped in turn."""
    return [value.bitwiseXOR(F.lit(mask_of([b])).cast("long")) for b in bits]


def links(prints: DataFrame, probes: list[Probe], steps: Steps, distance: int = 2) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp`: enough of them to connect all within `distance` bits.

    `distance` is 2 or less. A threshold of 1 or 2 writes a fingerprint to the buckets of all values
    within one bit on the partition, so two that differ there in at most two bits meet.
    """
    assert 0 <= distance <= 2
    entries = []
    for number, probe in enumerate(probes):
        if probe.threshold >= 0:
            key = F.col("fp").bitwiseAND(F.lit(mask_of(list(probe.bits))).cast("long"))
            for value in [key, *(_around(key, list(probe.bits)) if probe.threshold else [])]:
                entries.append(F.struct(F.lit(number).alias("part"), value.alias("key")))
    rows = prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.part", "e.key")
    rows = steps.keep(attach(rows, ["part", "key"], {"n": (F.count(F.lit(1)), F.sum)}, ["fp"]).filter("n > 1"))
    small = rows.filter(F.col("n") <= SMALL_BUCKET).groupBy("part", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= distance
    pairs = F.flatten(F.transform("fps", lambda a, i: F.transform(
        F.filter(F.slice(F.col("fps"), i + 2, F.lit(SMALL_BUCKET)), lambda b: close(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    found = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    # The rest: a value is at most one bit from 65 others, so no group here is larger than that.
    large = rows.filter(F.col("n") > SMALL_BUCKET).select("fp").distinct()
    if distance == 2:
        hubs = large.select("fp", F.explode(F.array(F.col("fp"), *_around(F.col("fp"), list(range(BITS))))).alias("hub"))
        via = hubs.groupBy("hub").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        via = via.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:  # one bit apart: one of the two is the other with a bit flipped
        flips = _around(F.col("fp"), list(range(BITS))) if distance else []
        via = large.select(F.col("fp").alias("a"), F.explode(F.array(F.col("fp"), *flips)).alias("b"))
        via = via.join(large.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    return found.unionByName(via).filter("a <> b")


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, the columns `carry`, fingerprint (a signed long), component_id and kept for every row of `docs`.

    Rows whose fingerprints differ in at most `distance` bits are linked; component_id is the smallest
    id reachable and one row that has it is kept. Null and blank texts have fingerprint 0 and are linked like any
    other; null ids come last; an empty table gives an empty result.
    """
    steps = Steps(docs, "simhash")
    columns = [F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)]
    rows = with_fingerprint(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), *columns), "body", shingle)
    rows = steps.keep(rows.select("doc.*", "fp", F.monotonically_increasing_id().alias("row")))
    lowest = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "row"))
    distinct = steps.keep(rows.groupBy("fp").agg(lowest.alias("low")))
    prints = distinct.select("fp")
    roots = components(links(prints, plan(prints, distance), steps, distance), steps)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = attach(rooted, ["root"], {"top": (F.min("low"), F.min)}, ["fp"]).select("fp", "top")
    out = look_up(rows, ["fp"], named, ["row"])
    back = [F.col(f"c_{i}").alias(c) for i, c in enumerate(carry) if c != doc_id]
    return out.select(
        F.col("id").alias(doc_id), *back, F.col("fp").alias("fingerprint"), F.col("top.id").alias("component_id"),
        (F.col("row") == F.col("top.row")).alias("kept"))
