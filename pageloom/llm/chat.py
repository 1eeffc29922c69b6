"""Chat formatting in windows of a token budget.

Prefix sums of the turns' tokens, made by Spark, place every turn in its conversation. A window takes the next
turns that fit; it begins with the conversation's system turn and a limited number of the tokens before it,
which are repeated for context. Only assistant turns that are new in a window carry loss, so every target
counts once. A conversation of many budgets is cut into segments by its prefix sums, each formatted by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageloom.llm import bpe
from pageloom.llm.common import Steps

BUDGET, HISTORY = 1024, 256
# Budgets in a segment; turns in a stretch that is summed by itself.
SEGMENT, STRETCH = 64, 256
# Tokens the marks of a turn take: its begin and end, and the line ends after its role and itself.
MARKS = 4

BEGIN, END = "<|im_start|>", "<|im_end|>"
SPANS = "conv_id {kind}, segment long, number int, text string, n_repeated int, n_tokens long, loss array<struct<start:int,end:int>>"
LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


# --- The template

def escape(text: str) -> str:
    """`text` without a control string in it: backslashes doubled, one put between < and |."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int]:
    """A turn, and where its text begins. A line end in a role is written as \\n."""
    head = f"{BEGIN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn."""
    at = 0
    while at < len(formatted):
        line, end = formatted.index("\n", at), formatted.index(END, at)
        yield unescape(formatted[at + len(BEGIN) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


def escaped(text: Column) -> Column:
    """`escape` as an expression."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def counted(rows: DataFrame, vocabulary: str | None, pattern: str | None) -> DataFrame:
    """`rows` (role, text) with `tokens`: those of role and text as they are written, and the marks.

    Without a vocabulary every byte counts as a token, which byte-level BPE never exceeds.
    """
    said = {"said": escaped(F.col("text")), "who": F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))}
    rows = rows.withColumns(said)
    if vocabulary is None:
        return rows.withColumn("tokens", (F.octet_length("said") + F.octet_length("who") + MARKS).cast("long")).drop("said", "who")
    for text in ("said", "who"):
        rows = bpe.with_token_count(rows, vocabulary, pattern, text, f"n_{text}").drop(text)
    return rows.withColumn("tokens", F.col("n_said") + F.col("n_who") + MARKS).drop("n_said", "n_who")


# --- Windows of one segment

@dataclass
class Turn:
    role: str
    text: str
    before: int
    upto: int

    @property
    def tokens(self) -> int:
        return self.upto - self.before


@dataclass
class Packer:
    """Packs the turns of a segment, given in order, into windows."""

    budget: int
    history: int
    system: Turn | None = None
    recent: list[Turn] = field(default_factory=list)  # at most `history` tokens
    repeated: list[Turn] = field(default_factory=list)
    new: list[Turn] = field(default_factory=list)

    def remember(self, turn: Turn) -> None:
        """Keep a turn to be repeated later, and forget those too far back."""
        if self.system is None or turn is not self.system:
            self.recent.append(turn)
        while self.recent and self.recent[-1].upto - self.recent[0].before > self.history:
            self.recent.pop(0)

    def _start(self, turn: Turn) -> None:
        lead = [self.system] if self.system is not None else []
        room = self.budget - turn.tokens - sum(t.tokens for t in lead)
        self.repeated = lead + [t for t in self.recent if self.recent[-1].upto - t.before <= room]

    def add(self, turn: Turn) -> tuple | None:
        """Take the next turn; gives the finished window when it does not fit."""
        done = None
        if self.new and sum(t.tokens for t in self.repeated) + turn.upto - self.new[0].before > self.budget:
            done = self.window()
        if not self.new:
            self._start(turn)
        self.new.append(turn)
        return done

    def window(self) -> tuple | None:
        """(text, number of repeated turns, tokens, loss spans) of what was taken since the last one."""
        if not self.new:
            return None
        parts, loss, length = [], [], 0
        for i, turn in enumerate([*self.repeated, *self.new]):
            text, head = render(turn.role, turn.text)
            if i >= len(self.repeated) and turn.role == "assistant":
                loss.append({"start": length + head, "end": length + len(text) - len(END) - 1})
            parts.append(text)
            length += len(text)
        out = ("".join(parts), len(self.repeated), sum(t.tokens for t in self.repeated) + self.new[-1].upto - self.new[0].before, loss)
        for turn in self.new:
            self.remember(turn)
        self.new, self.repeated = [], []
        return out


# --- Spark

def placed(rows: DataFrame) -> DataFrame:
    """`rows` (conv, turn, role, text, tokens) with before and upto: tokens of the conversation's turns so far.

    Summed per stretch of turns first, so a long conversation is not one task's work.
    """
    # A struct is a key that may hold a null; the join and the window share one shuffle by it.
    rows = rows.withColumns({"key": F.struct("conv"), "stretch": F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-1)).cast("long")})
    sums = rows.groupBy("key", "stretch").agg(F.sum("tokens").alias("n"))
    ahead = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "key", "stretch", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("key")).alias("whole"))
    along = Window.partitionBy("key", "stretch").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("so_far", F.sum("tokens").over(along)).join(starts, ["key", "stretch"])
    rows = rows.withColumn("upto", F.col("start") + F.col("so_far")).withColumn("before", F.col("upto") - F.col("tokens"))
    return rows.drop("key", "stretch", "start", "so_far")


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_id: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text", vocabulary: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """Windows of every conversation: conv_id, segment, number, text, n_repeated, n_tokens, loss (start, end in `text`).

    Rows are taken by turn (nulls first), then role and text; rows that repeat are turns of their own. Null roles and
    texts count as empty, a null conv_id is a conversation. A window keeps to `budget` tokens unless its system turn and
    first new turn alone exceed it; turns are never cut. Tokens are those of the rank file `vocabulary`, split by `pattern`; without
    one, bytes. An empty table gives no window. The first `n_repeated` turns stood in an earlier window.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    rows = placed(Steps(turns, "chat").keep(counted(rows, vocabulary, pattern)))
    size = SEGMENT * budget
    segment = F.floor(F.col("before") / size)
    # A turn stands in its segment, at the end of one also in the next for context; the system turn in all.
    follows = F.floor((F.col("whole") - 1) / size)
    first = (F.col("before") == 0) & (F.col("role") == "system")
    near = (F.col("upto") > (segment + 1) * size - history) & (segment < follows)
    none = F.array().cast("array<struct<segment:bigint,part:int>>")
    place = lambda s, part: F.struct(s.cast("long").alias("segment"), F.lit(part).alias("part"))
    places = F.concat(
        F.array(place(segment, 2)),
        F.when(first & (follows > 0), F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(follows, F.lit(1))), lambda s: place(s, 0))).otherwise(none),
        F.when(~first & near, F.array(place(segment + 1, 1))).otherwise(none))
    rows = rows.select("conv", "turn", "role", "text", "before", "upto", F.explode(places).alias("p"))
    rows = rows.select("conv", "p.segment", "p.part", "role", "text", "before", "upto")
    rows = rows.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "part", "before", "upto")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, packer, number, held, chars = None, None, 0, [], 0

        def keep(window: tuple | None) -> None:
            nonlocal number, chars
            if window is not None:
                held.append((*key, number, *window))
                number, chars = number + 1, chars + len(window[0])

        for batch in batches:
            for conv, seg, part, who, said, before, upto in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, seg) != key or packer is None:
                    if packer is not None:
                        keep(packer.window())
                    key, packer, number = (conv, seg), Packer(budget, history), 0
                one = Turn(who, said, before, upto)
                if before == 0 and who == "system" and packer.system is None:
                    packer.system = one
                    if part == 2:  # it is new in the first window, and so not also repeated there
                        packer.new.append(one)
                elif part == 1:
                    packer.remember(one)
                else:
                    keep(packer.add(one))
                if chars >= 1 << 23:
                    yield batch_of(held)
                    held, chars = [], 0
        if packer is not None:
            keep(packer.window())
        if held:
            yield batch_of(held)

    kind = turns.schema[conv_id].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else None

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        conv, seg, number, text, n_repeated, n_tokens, loss = (list(c) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, arrow), pa.array(seg, pa.int64()), pa.array(number, pa.int32()), pa.array(text, pa.string()),
             pa.array(n_repeated, pa.int32()), pa.array(n_tokens, pa.int64()), pa.array(loss, LOSS)],
            ["conv_id", "segment", "number", "text", "n_repeated", "n_tokens", "loss"])

    return rows.mapInArrow(run, SPANS.format(kind=kind)).withColumnRenamed("conv_id", conv_id)


def new_turns(window: str, n_repeated: int) -> list[tuple[str, str]]:
    """(role, text) of the turns that are new in a window."""
    return list(parse(window))[n_repeated:]
