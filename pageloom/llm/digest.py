"""Similarity digests of documents: improbable windows of bytes in chained Bloom filters.

Every window of 64 bytes has an entropy, rounded to one of 1,001 levels. How often each level occurs in the whole corpus
ranks the windows: the rarer the level, the less probable the window. Among 64 windows in a row the
rarest gets a point; those with enough points are the document's features. A feature sets five bits of a Bloom filter of
2,048 bits; after 160 features the next filter of the chain begins. Two digests are as like as the filters of
the shorter one find their match in the other: bits in common, beyond those due to chance, relative to
the most there could be. All sums are of integers, so equal texts have equal digests on any machine.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Steps

# Bytes in a window, which is also the number of windows among which one gets a point; levels of entropy.
WINDOW, LEVELS = 64, 1000
# Windows of a lower level (long repetitions of few bytes) tell documents apart too badly to be features.
LEAST_LEVEL = 100
# Points a feature needs; where a text has none with so many, those with most are taken.
POINTS = 16
# Bits and features of a filter, bits a feature sets.
BITS, FEATURES, HASHES = 2048, 160, 5
# The share of the possible overlap beyond chance that still counts as none.
CUTOFF = 0.3

# Bytes of texts handled together, and of a block of them; only memory depends on them.
TOGETHER, BLOCK = 1 << 20, 1 << 16
# Rank of windows that cannot be features.
NEVER = LEVELS + 1

_COUNTS = np.arange(WINDOW + 1)
_WEIGHT = np.round(np.where(_COUNTS > 0, _COUNTS * np.log2(np.maximum(_COUNTS, 1)), 0) * (1 << 20)).astype(np.int64)
_MORE = np.diff(_WEIGHT, append=_WEIGHT[-1])  # what one more of a byte adds
_WHOLE = int(_WEIGHT[-1])  # of a window of one byte only: entropy 0


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The level, 0 to 1,000, of the window at each place of the bytes `data`."""
    n = len(data) - WINDOW + 1
    out = np.empty(max(n, 0), np.int16)
    for at in range(0, n, BLOCK):
        part = data[at : at + BLOCK + WINDOW - 1]
        before, after = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for d in range(1, WINDOW):  # how often a byte stands among the 63 before it and after it
            same = (part[d:] == part[:-d]).view(np.uint8)
            before[d:] += same
            after[:-d] += same
        first = int(_WEIGHT[np.bincount(part[:WINDOW])].sum())
        change = _MORE[before[WINDOW:]] - _MORE[after[:-WINDOW]]
        sums = np.append(first, first + np.cumsum(change))
        out[at : at + len(sums)] = (_WHOLE - sums) * LEVELS // _WHOLE
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array of bytes, and where each begins, with the end of the last."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _inside(starts: np.ndarray, n: int) -> np.ndarray:
    """Whether the window at each of `n` places lies in one text."""
    marks = np.zeros(n + 1, np.int32)
    sizes = np.diff(starts)
    some = sizes >= WINDOW
    np.add.at(marks, starts[:-1][some], 1)
    np.add.at(marks, starts[1:][some] - WINDOW + 1, -1)
    return np.cumsum(marks[:-1]) > 0


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each level."""
    data, starts = joined(texts)
    levels = entropy_levels(data)
    return np.bincount(levels[_inside(starts, len(levels))], minlength=LEVELS + 1)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of every level: 0 for the one that is met least often; of equals the lower level first."""
    ranks = np.empty(LEVELS + 1, np.int32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(LEVELS + 1)
    ranks[:LEAST_LEVEL] = NEVER
    return ranks


def _points(ranks: np.ndarray) -> np.ndarray:
    """How often each window is the rarest, the leftmost of equals, of the 64 from some place on."""
    n, shift = len(ranks), 17
    points = np.zeros(n + WINDOW, np.int32)
    padded = np.append(ranks, np.full(WINDOW - 1, NEVER, np.int32))
    for at in range(0, n, BLOCK):
        part = padded[at : at + BLOCK + WINDOW - 1]
        least = part << shift | np.arange(len(part), dtype=np.int32)
        for step in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-step], least[step:])
        # A window that reaches over the end of its text asks for none, it is itself none.
        least = least[(least >> shift != NEVER) & (part[: len(least)] != _OUTSIDE)]
        points[at : at + len(part)] += np.bincount(least & ((1 << shift) - 1), minlength=len(part))
    return points[:n]


_OUTSIDE = NEVER + 1


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each window."""
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), BLOCK):
        words = data[at[lo : lo + BLOCK, None] + np.arange(WINDOW)].view("<u8")
        h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
        for i in range(words.shape[1]):
            h = (h ^ words[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        out[lo : lo + BLOCK] = h ^ h >> np.uint64(32)
    return out


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text, an array (filters, 32) of words of 64 bits.

    A text without features (one of under 64 bytes, or of few different bytes) is a feature as a whole; an empty one has no filters.
    """
    data, starts = joined(texts)
    levels = entropy_levels(data)
    n = len(levels)
    whose, hashes = np.empty(0, np.int64), np.empty(0, np.uint64)
    if n > 0:
        inside = _inside(starts, n)
        points = _points(np.where(inside, ranks[levels], _OUTSIDE))
        found = np.flatnonzero(points)
        owner = np.searchsorted(starts, found, "right") - 1
        most = np.zeros(len(texts), np.int32)
        np.maximum.at(most, owner, points[found])
        good = points[found] >= np.minimum(most[owner], POINTS)
        whose, hashes = owner[good], _hashes(data, found[good])
    bare = np.array([i for i in np.flatnonzero(np.bincount(whose, minlength=len(texts)) == 0).tolist() if texts[i]], np.int64)
    whole = np.array([xxhash.xxh64_intdigest(texts[i]) for i in bare.tolist()], np.uint64)
    whose, hashes = np.concatenate([whose, bare]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, whose))  # stable: the first of equal features of a text stays
    new = np.append(True, (np.diff(whose[order]) != 0) | (np.diff(hashes[order]) != 0)) if len(order) else np.empty(0, bool)
    kept = np.sort(order[new])
    kept = kept[np.argsort(whose[kept], kind="stable")]
    whose, hashes = whose[kept], hashes[kept]
    sizes = np.bincount(whose, minlength=len(texts))
    ordinal = np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    chains = -(-sizes // FEATURES)
    ends = np.cumsum(chains)
    number = (ends - chains)[whose] + ordinal // FEATURES
    bits = np.zeros((int(chains.sum()), BITS), bool)
    for i in range(HASHES):
        bits[number, (hashes >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = True
    filters = np.packbits(bits, axis=1).view(np.uint64)
    return [filters[end - chain : end] for end, chain in zip(ends.tolist(), chains.tolist(), strict=True)]


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """How like two digests are, 0 to 1; the order does not matter. Two empty ones are alike, an empty one is like no other."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    if np.array_equal(one, two):
        return 1.0
    if len(one) == len(two):
        return (_matched(one, two) + _matched(two, one)) / 2
    return _matched(one, two) if len(one) < len(two) else _matched(two, one)


def _matched(short: np.ndarray, other: np.ndarray) -> float:
    set_ = np.bitwise_count(other).sum(axis=1, dtype=np.int64)
    total = 0.0
    for filter_ in short:
        own = int(np.bitwise_count(filter_).sum(dtype=np.int64))
        both = np.bitwise_count(other & filter_).sum(axis=1, dtype=np.int64)
        most, chance = np.minimum(set_, own), set_ * own / BITS
        none = chance + CUTOFF * (most - chance)
        total += float(np.clip((both - none) / np.maximum(most - none, 1e-9), 0, 1).max())
    return total / len(short)


def packed(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def unpacked(digest: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(digest), np.uint64).reshape(-1, BITS // 64)


# --- Spark

def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > TOGETHER:
            yield lo, i
            lo, held = i, 0
        held += size
    if len(sizes) > lo:
        yield lo, len(sizes)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for lo, hi in _chunks(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
        yield batch.slice(lo, hi - lo)


def _bytes(texts: pa.Array) -> list[bytes]:
    return [text or b"" for text in texts.cast(pa.binary()).to_pylist()]


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The ranks of levels by how many windows of all texts have them; a count per level comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for part in _parts(batch, 0):
                counts += level_counts(_bytes(part.column(0)))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met])], ["level", "n"])

    counts = np.zeros(LEVELS + 1, np.int64)
    for row in docs.select(text).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[row["level"]] = row["n"]
    return ranks_of(counts)


def with_digests(docs: DataFrame, ranks: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: str = "fingerprint") -> DataFrame:
    """The columns `keep` of `docs` and the digest of each text, base 64; null counts as empty. Rows neither move nor change their number."""
    keep = tuple(c for c in keep if c != digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, len(keep)):
                made = pa.array([packed(d) for d in digests(_bytes(part.column(len(keep))), ranks)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], made], [*names, "digest"])

    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "digest string"])
    return docs.select(*keep, text).mapInArrow(run, schema).toDF(*keep, digest)


def with_likeness(pairs: DataFrame, one: str, two: str, name: str = "likeness") -> DataFrame:
    """`pairs` with the likeness of two columns of digests; null where one is null."""
    @F.pandas_udf("double")
    def like(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else likeness(unpacked(a), unpacked(b)) for a, b in zip(left, right, strict=True)], dtype="float64")

    return pairs.withColumn(name, like(one, two))


# Rows a part of the ordered documents has at least, and parts there are at most beside one per task that sorted them.
LEAST_PART, MOST_PARTS = 256, 1 << 16
KEY = np.dtype([("absent", np.int8), ("id", np.int64), ("hash", np.int64)])


def _keys(absent: pd.Series, ids: pd.Series, hashes: pd.Series) -> np.ndarray:
    keys = np.empty(len(absent), KEY)
    keys["absent"], keys["id"], keys["hash"] = absent, ids, hashes
    return keys


def dealt_with_next(docs: DataFrame, doc_id: str, text: str, steps: Steps) -> DataFrame:
    """(id, text, part, ahead): rows by falling id in parts of consecutive ones, dealt out and sorted.

    Only ids and hashes are sorted as a whole. The first row of a part is also sent, as `ahead`, to the
    end of the part before, that of the first part to the last; so every row's next one stands behind it. A key per part comes to the driver.
    """
    absent, falling = F.col(doc_id).isNull().cast("int"), F.coalesce(F.bitwise_not(F.col(doc_id).cast("long")), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), absent.alias("absent"), falling.alias("falling"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    order = ["absent", "falling", "hash"]
    sorted_ = rows.select(*order).repartitionByRange(*order, F.rand(1)).sortWithinPartitions(*order)
    sorted_ = steps.keep(sorted_.withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    each = max(LEAST_PART, sorted_.count() // MOST_PARTS + 1)
    first = sorted_.filter(F.col("at") % each == 0).select(*order).distinct().toPandas()
    bounds = np.unique(_keys(first["absent"], first["falling"], first["hash"]))
    n = max(len(bounds), 1)

    @F.pandas_udf("long")
    def place(absent: pd.Series, falling: pd.Series, hash_: pd.Series) -> pd.Series:
        keys = _keys(absent, falling, hash_)
        part = np.searchsorted(bounds, keys, "right") - 1
        return pd.Series(part * 2 + (bounds[part] == keys))

    rows = rows.withColumn("place", place(*order))
    here = F.struct((F.col("place") / 2).cast("long").alias("part"), F.lit(False).alias("ahead"))
    there = F.struct(F.pmod((F.col("place") / 2).cast("long") - 1, F.lit(n)).alias("part"), F.lit(True).alias("ahead"))
    rows = rows.select("id", "text", *order, F.explode(F.when(F.col("place") % 2 == 1, F.array(here, there)).otherwise(F.array(here))).alias("p"))
    rows = rows.select("id", "text", *order, "p.part", "p.ahead")
    return rows.repartition("part").sortWithinPartitions("part", "ahead", *order).select("id", "text", "part", "ahead")


def edited(text: str, after: str) -> str:
    """`text` with its last half, rounded down, replaced by as many characters of the beginning of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


RESULT = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT_SQL = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's digest beside that of an edited copy and of the next document: how far likeness follows what is shared.

    Documents are taken by falling id (an integer; nulls last), rows of one id by a hash of the text, which is the order of
    texts; after the last comes the first. The copy has its last half replaced by the beginning of the next document.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row; null
    texts count as empty, rows that repeat are each other's next, a single row is its own; an empty table gives an empty result.
    """
    steps, ranks = Steps(docs, "digest"), rarity(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (id, text, part, ahead, digest) of the row before
        for batch in batches:
            for some in _parts(batch, 1):
                rows = list(zip(*(c.to_pylist() for c in some.columns), strict=True))
                made = digests([r[1].encode() for r in rows], ranks)
                line = [*([last] if last else []), *((*r, d) for r, d in zip(rows, made, strict=True))]
                last = line[-1]
                pairs = [(a, b) for a, b in zip(line, line[1:], strict=False) if a[2] == b[2] and not a[3]]
                for lo, hi in _chunks([4 * len(a[1]) for a, _ in pairs]):
                    copies = [edited(a[1], b[1]).encode() for a, b in pairs[lo:hi]]
                    done = [
                        (a[0], len(a[1]), hashlib.sha256(copy).hexdigest(), packed(a[4]), packed(digest), likeness(a[4], digest), likeness(a[4], b[4]))
                        for (a, b), copy, digest in zip(pairs[lo:hi], copies, digests(copies, ranks), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), RESULT.types, strict=True)], RESULT.names)

    return dealt_with_next(docs, doc_id, text, steps).mapInArrow(run, RESULT_SQL).select(
        F.col("id").cast(docs.schema[doc_id].dataType).alias(doc_id), *RESULT.names[1:])
