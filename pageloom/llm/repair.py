"""Repair of a conversation's structure as a lightest derivation, found with Knuth's agenda.

An item (i, q) says that the first i rows are dealt with and the roles given so far end in state q. An edit
of the next row, or an inserted turn, derives an item from another; its weight is a cost and a letter.
Weights compare by cost, then by the letters so far (the audit). Every edit adds a letter at the end and no
negative cost, so a conclusion never weighs less than its premise, and of two audits of equal cost over the
same rows none begins the other (letters beyond would be insertions, which cost), so a lighter premise never gives a heavier
conclusion. Hence the first pop of an item is final, and the search ends when the goals are popped.

A long conversation is cut into pieces. Each piece derives the lightest way from every state to every other, and these
are items again: two that meet derive the way through both. So one conversation may hold any share of
the rows; what is serial is the chain of its pieces, and its one digest.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Steps, attach

# log2 of the rows in a piece.
PIECE = 8
# Characters of a text that rows of one turn and role are ordered by, before a hash of the whole.
ORDERED = 64

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# States: nothing yet, after the system turn, after a user's, after an assistant's. Roles given must read (s?(ua)+)?.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FOLLOWING = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ACCEPTED = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")

# The faults a row counts for.
SOUND, BLANK, DUPLICATE, CUT = range(4)

Path = tuple[int, str]


class Row(NamedTuple):
    initial: str
    fault: int


def kept_state(state: int, initial: str) -> int | None:
    """The state after a turn of this role initial, where it may stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    follows = FOLLOWING[state]
    return follows if initial == ROLES[follows][0] else None


def edits(state: int, row: Row) -> Iterator[tuple[int, str, int]]:
    """(cost, letter, next state) of what may be done with a row."""
    yield DELETE, "D", state
    if row.fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if row.fault == CUT else 0
    kept = kept_state(state, row.initial)
    if kept is not None:
        yield extra, "K", kept
    yield extra + REROLE, "R", FOLLOWING[state]


def lightest(rows: list[Row], entry: int) -> dict[int, Path]:
    """The lightest (cost, audit) from `entry` to every state that can be reached over all rows."""
    open_system = entry == START and any(r.initial == "s" and r.fault in (SOUND, CUT) for r in rows)
    goals = {START: 3 + open_system, SYSTEM: 3, USER: 2, ASSISTANT: 2}[entry]
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    final: set[tuple[int, int]] = set()
    found: dict[int, Path] = {}
    while agenda and len(found) < goals:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(rows):
            found[state] = (cost, audit)
        else:
            for more, letter, after in edits(state, rows[i]):
                if (i + 1, after) not in final:
                    heapq.heappush(agenda, (cost + more, audit + letter, i + 1, after))
        if (i, FOLLOWING[state]) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, FOLLOWING[state]))
    return found


def joined(ways: dict[int, Path], piece: dict[tuple[int, int], Path]) -> dict[int, tuple[Path, int]]:
    """The lightest ways through `ways` and then the piece: by exit, with the state they met in."""
    out: dict[int, tuple[Path, int]] = {}
    for (entry, exit_), (cost, audit) in piece.items():
        if entry in ways:
            way = ((ways[entry][0] + cost, ways[entry][1] + audit), entry)
            if exit_ not in out or way < out[exit_]:
                out[exit_] = way
    return out


def apply(audit: str, entry: int, rows: list[tuple[str, str]]) -> list[str]:
    """The turns (`role:text`) an audit makes of the rows (role, text), starting in state `entry`."""
    out, state, left = [], entry, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        if letter == "K":
            state = SYSTEM if role[:1] == "s" else FOLLOWING[state]
        else:
            state = FOLLOWING[state]
            role = ROLES[state]
        out.append(f"{role}:{text}")
    return out


# --- Spark

def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
PIECES = pa.schema([
    ("key", pa.string()), ("piece", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("ways", WAYS)])
PIECES_SQL = ("key string, piece long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long, "
              "ways array<struct<entry:int,exit:int,cost:long,audit:string>>")
CHOSEN = pa.schema([
    ("key", pa.string()), ("piece", pa.int64()), ("entry", pa.int32()), ("part", pa.string()), ("whole", pa.bool_()), ("gaps", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
CHOSEN_SQL = ("key string, piece long, entry int, part string, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, "
              "cost long, audit string")


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, piece, turn, initial, fault) in order to pieces with their ways."""
    def pieces() -> Iterator[tuple]:
        for (key, piece), rows in groupby(_columns(batches), lambda r: r[:2]):
            _, _, turns, initials, faults = zip(*rows, strict=True)
            ways = [{"entry": entry, "exit": exit_, "cost": cost, "audit": audit}
                    for entry in FOLLOWING for exit_, (cost, audit) in lightest(list(map(Row, initials, faults)), entry).items()]
            known = [t for t in turns if t is not None]
            yield (key, piece, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
                   sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), initials[0], initials[-1],
                   len(set(known)), known[0] if known else None, known[-1] if known else None, ways)

    return _batched(pieces(), PIECES)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation in order to the edits of each; the last one's row has the conversation's figures."""
    def chosen() -> Iterator[tuple]:
        for key, pieces in groupby(_columns(batches), lambda r: r[0]):
            ways: dict[int, Path] = {START: (0, "")}
            back: list[dict[int, tuple[int, str]]] = []
            numbers, sums, turns, low, high, before = [], [0] * 4, 0, None, None, None
            for _, piece, *counts, first, last, n_turns, least, most, steps in pieces:
                table = {(w["entry"], w["exit"]): (w["cost"], w["audit"]) for w in steps}
                met = joined(ways, table)
                back.append({exit_: (entry, table[entry, exit_][1]) for exit_, (_, entry) in met.items()})
                ways = {exit_: way for exit_, (way, _) in met.items()}
                numbers.append(piece)
                sums = [a + b for a, b in zip(sums, counts, strict=True)]
                sums[3] += before is not None and before + first not in LEGAL
                before = last
                if n_turns:
                    turns += n_turns - (least == high)
                    low, high = least if low is None else low, most
            (cost, audit), state = min((ways[q], q) for q in ACCEPTED if q in ways)
            parts = []
            for number, come in zip(reversed(numbers), reversed(back), strict=True):
                state, part = come[state]
                parts.append((key, number, state, part))
            gaps = high - low + 1 - turns if turns else 0
            figures = (gaps, *sums, cost, audit)
            for i, part in enumerate(reversed(parts)):
                yield (*part, len(parts) == 1, *(figures if i == len(parts) - 1 else [None] * len(figures)))

    return _batched(chosen(), CHOSEN, 64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's edits (key, piece, entry, part, whole) and then its rows (role, text) to its turns, or the digest where it is the whole."""
    def parts() -> Iterator[tuple]:
        for (key, piece), rows in groupby(_columns(batches), lambda r: r[:2]):
            _, _, entry, audit, whole, _, _ = next(rows)
            turns = apply(audit, entry, [(r[5], r[6]) for r in rows])
            text = "\n".join(turns)
            yield (key, piece, None, hashlib.sha256(text.encode()).hexdigest()) if whole else (key, piece, text if turns else None, None)

    return _batched(parts(), pa.schema([("key", pa.string()), ("piece", pa.int64()), ("text", pa.string()), ("digest", pa.string())]), 64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (key, piece, text) in order to a digest per conversation, one piece in memory at a time."""
    def digests() -> Iterator[tuple]:
        for key, pieces in groupby(_columns(batches), lambda r: r[0]):
            sha, begun = hashlib.sha256(), False
            for _, _, text in pieces:
                if text is not None:
                    sha.update(("\n" if begun else "").encode() + text.encode())
                    begun = True
            yield key, sha.hexdigest()

    return _batched(digests(), pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())]))


def _in_order(rows: DataFrame, by: list[str], then: list[str]) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by, *then)


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (an integer; nulls first); those of one turn by role, the first characters of the text and its hash, and rows
    that repeat stay side by side. Null roles and texts count as empty, a null conv_id is a conversation; roles are
    told apart by their first letter, and a row without one is never kept as it is. `gaps` are the turn
    numbers missing between the first and the last; a row counts as blank, else duplicate, else truncated; `illegal` are neighbours
    whose roles do not follow each other. `audit` has the letters of the edits (D, I, K, R) of the cheapest
    repair, the least in ASCII of equals. Other columns are left out; an empty table gives an empty result.
    """
    steps = Steps(turns, "repair")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    # The key is never null: ids come back from it by their type.
    key = F.when(F.col(conv_id).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(conv_id).cast("string")))
    rows = turns.select(key.alias("key"), F.col(turn).cast("long").alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    order = ["key", "turn", "role", "head", "hash", "row"]
    rows = rows.withColumns({"head": F.substring("text", 1, ORDERED), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Places rise through the sorted partitions.
    rows = steps.keep(rows.select("key", "turn", "role", "text", F.monotonically_increasing_id().alias("at")))
    rows = rows.withColumn("piece", F.shiftright("at", PIECE))
    return _named(_repaired(rows, steps), turns, conv_id)


def _faults(rows: DataFrame) -> DataFrame:
    """(key, piece, at, turn, initial, fault) of every row."""
    said = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")) > 0
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    facts = rows.select("key", "piece", "at", "turn", F.substring("role", 1, 1).alias("initial"), (~said).alias("blank"), ended.alias("ended"), digest.alias("digest"))
    facts = attach(facts, ["key", "digest"], {"earliest": (F.min("at"), F.min)}, ["at"])
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("earliest"), DUPLICATE).when(~F.col("ended"), CUT).otherwise(SOUND)
    return facts.select("key", "piece", "at", "turn", "initial", fault.cast("int").alias("fault"))


def _repaired(rows: DataFrame, steps: Steps) -> DataFrame:
    ordered = _in_order(_faults(rows), ["key", "piece"], ["at"]).select("key", "piece", "turn", "initial", "fault")
    pieces = _in_order(ordered.mapInArrow(_weigh, PIECES_SQL), ["key"], ["piece"])
    chosen = steps.keep(pieces.mapInArrow(_choose, CHOSEN_SQL))
    # Not a join, which may be split where a piece is: the edits of a piece come before its rows.
    both = chosen.select("key", "piece", F.lit(-1).cast("long").alias("at"), "entry", "part", "whole").unionByName(
        rows.select("key", "piece", "at", "role", "text"), allowMissingColumns=True)
    both = _in_order(both, ["key", "piece"], ["at"]).select("key", "piece", "entry", "part", "whole", "role", "text")
    texts = steps.keep(both.mapInArrow(_texts, "key string, piece long, text string, digest string"))
    long_ = _in_order(texts.filter("digest is null").select("key", "piece", "text"), ["key"], ["piece"])
    digests = texts.filter("digest is not null").select("key", F.col("digest").alias("repaired_sha256")).unionByName(
        long_.mapInArrow(_digests, "key string, repaired_sha256 string"))
    return chosen.filter("cost is not null").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").join(digests, "key")


def _named(found: DataFrame, turns: DataFrame, conv_id: str) -> DataFrame:
    kind = turns.schema[conv_id].dataType
    id_ = F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).cast(kind)
    return found.select(id_.alias(conv_id), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`turns` with faults put in by a checksum of conversation and turn: rows dropped, emptied, cut, repeated or with another role.

    Nulls count as one space, in the checksum as well as in role and text; so the same rows always suffer the same.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn))) % 20
    copies = F.when(F.col("chance") == 0, F.array().cast("array<int>")).when(F.col("chance") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), chance.alias("chance"))
    rows = rows.select("*", F.explode(copies).alias("copy"))
    said: Column = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"))
