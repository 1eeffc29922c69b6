"""Byte-level BPE: a lazily determinised transducer for encoding, an incremental UTF-8 machine for decoding.

The rank table is read as a transducer over bytes. While reading, several beginnings of tokens are
open at once: each is a hypothesis of the tokens already complete before it, the last of them, and the bytes read of
the next. Completing a token is allowed where the merges leave it beside the one before; then
exactly one hypothesis ends at every byte. A set of hypotheses is a state of the deterministic
machine, built when reached for the second time. Tokens all hypotheses agree on are emitted at once, so output lags by at most
about a token's length.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pageloom.llm.common import held

# Deterministic states, remembered pieces and remembered pairs kept before starting over; all only save time.
MOST_STATES, MOST_PIECES, MOST_PAIRS = 80_000, 400_000, 300_000
# Characters of a text up to which its pieces are listed at once.
LISTED = 1 << 22
# Token ids decoded at a time.
BLOCK = 1 << 16

# Tokens complete but not emitted, the last complete token, and the place in the trie of the next.
Hypothesis = tuple[tuple[int, ...], int, int]
NONE = -1


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The table of a rank file: lines of a token in base 64 and its rank, which is its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class State(dict):
    """A deterministic state: the arc of every byte met twice, which is the next state and the tokens emitted on the way."""

    __slots__ = ("hypotheses",)

    def __init__(self, hypotheses: tuple[Hypothesis, ...]) -> None:
        self.hypotheses = hypotheses

    def __missing__(self, byte: int) -> tuple[None, bool]:
        self[byte] = MET
        return NEW


# In place of an arc: the byte was met once before, or never.
MET, NEW = (None, False), (None, True)


class Transducer:
    """Encodes pieces of bytes by rank, a state per byte."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.never = ranks, len(ranks) + max(ranks.values(), default=0)
        self.tokens = {rank: token for token, rank in ranks.items()}
        # The trie: the node after a byte, the token that ends at a node, and whether others go on from it.
        self.next: dict[int, int] = {}
        self.ends, self.goes_on = [NONE], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.goes_on[node] = True
                step = self.next.setdefault(node << 8 | byte, len(self.ends))
                if step == len(self.ends):
                    self.ends.append(NONE)
                    self.goes_on.append(False)
                node = step
            self.ends[node] = rank
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]] | None] = {}
        self.beside: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        start: tuple[Hypothesis, ...] = (((), NONE, 0),)
        self.start = State(start)
        self.states = {start: self.start}
        if len(self.beside) > MOST_PAIRS:
            self.beside.clear()

    def _half(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes `token`; none when the merges never make it."""
        if token not in self.halves:
            ranks, never = self.ranks, self.never
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                made = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
                if (low := min(made)) == never:
                    break
                at = made.index(low)  # the leftmost of equals
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int]] | None:
        """The parts standing at one end of `token` while it is merged, each with the rank that ends it."""
        key = (token, right)
        if key not in self.edges:
            edge, part, until = [], self.tokens[token], self.never
            while len(part) > 1 and edge is not None:
                edge.append((part, until))
                until, halves = self.ranks[part], self._half(part)
                part, edge = (halves[right], edge) if halves else (part, None)
            if edge is not None:
                edge.append((part, until))
                edge.reverse()
            self.edges[key] = edge
        return self.edges[key]

    def _fits(self, last: int, token: int) -> bool:
        """Whether the merges leave `last` and `token` whole side by side.

        Merges go by rising rank. The parts at the touching ends grow in turn; the two stay apart
        unless some pair of ends merges across before either grows. Of equal ranks the left goes first.
        """
        right = self._edge(token, False)
        left = self._edge(last, True) if last != NONE else []
        if right is None or left is None:
            return False
        if not left:
            return True
        ranks, never, i, j = self.ranks, self.never, 0, 0
        while True:
            (a, a_until), (b, b_until) = left[i], right[j]
            across = ranks.get(a + b, never)
            if across < a_until and across <= b_until and across < never:
                return False
            if a_until == never and b_until == never:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def _read(self, hypotheses: Iterable[tuple], byte: int) -> list[tuple]:
        """The hypotheses after `byte`; that with a complete token comes last, its pending tokens being a pair of those before and itself."""
        moved, ended, beside, step, ends, goes_on = [], None, self.beside, self.next, self.ends, self.goes_on
        for pending, last, node in hypotheses:
            node = step.get(node << 8 | byte)
            if node is None:
                continue
            if goes_on[node]:
                moved.append((pending, last, node))
            token = ends[node]
            if token != NONE and ended is None:  # exactly one hypothesis ends at a byte
                pair = (last + 1) << 32 | token
                fits = beside.get(pair)
                if fits is None:
                    fits = beside[pair] = self._fits(last, token)
                if fits:
                    ended = ((pending, token), token, 0)
        assert ended is not None, "the rank table lacks a byte"
        moved.append(ended)
        return moved

    def _finish(self, hypotheses: tuple[Hypothesis, ...], rest: bytes) -> list[int]:
        """The tokens still to come when `rest` is the last of a piece, without building states."""
        now: Iterable[tuple] = [((None, pending), last, node) for pending, last, node in hypotheses]
        for byte in rest:
            now = self._read(now, byte)
        pending, out = now[-1][0], []
        while pending[0] is not None:
            out.append(pending[1])
            pending = pending[0]
        return [*pending[1], *reversed(out)]

    def _arc(self, hypotheses: tuple[Hypothesis, ...], byte: int) -> tuple[State, tuple[int, ...]]:
        """The arc for `byte`: the next state, made when it is new, and the tokens emitted on the way."""
        moved = self._read(hypotheses, byte)
        (pending, token), last, node = moved[-1]
        moved[-1] = ((*pending, token), last, node)
        emitted: tuple[int, ...] = ()
        if moved[0][0]:
            shared = 0
            for tokens in zip(*(pending for pending, _, _ in moved), strict=False):
                if len(set(tokens)) > 1:
                    break
                shared += 1
            if shared:
                emitted = moved[0][0][:shared]
                moved = [(pending[shared:], last, node) for pending, last, node in moved]
        key = tuple(moved)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State(key)
        return state, emitted

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The next state and the tokens emitted, whether or not the byte was met here before."""
        after, emitted = state[byte]
        if after is None:
            after, emitted = state[byte] = self._arc(state.hypotheses, byte)
        return after, emitted

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MOST_STATES:
            self._forget()
        state, out = self.start, []
        for at, byte in enumerate(piece):
            after, emitted = state[byte]
            if after is None:
                if emitted:  # a byte never met here: most such ends of pieces are met once only
                    return out + self._finish(state.hypotheses, piece[at:])
                after, emitted = self.step(state, byte)
            state = after
            if emitted:
                out += emitted
        out += state.hypotheses[-1][0]
        return out


class Encoder(dict):
    """Encodes texts; as a dict it remembers the ids of pieces, packed."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.pieces, self.machine = regex.compile(pattern), Transducer(ranks)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.machine.encode(piece.encode())).tobytes()
        if len(piece) < 64:
            if len(self) >= MOST_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text; matches of the pattern are encoded separately."""
        found = self.pieces.findall(text) if len(text) <= LISTED else (m.group() for m in self.pieces.finditer(text))
        return np.frombuffer(b"".join(map(self.__getitem__, found)), np.int32)


class Utf8Stream:
    """Turns bytes that come in any cuts into text; a character is given out when its last byte came.

    The state is how many continuation bytes are missing and the range the next one must lie in.
    UTF-8 shows where characters begin, so after a block the state follows from its last three bytes.
    Bytes that cannot be UTF-8 become U+FFFD.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _unfinished(tail: bytes) -> bool:
        """Whether `tail`, a lead byte and what follows, is the beginning of a character."""
        lead = tail[0]
        missing = 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
        for byte in tail[1:]:
            if not missing or not low <= byte <= high:
                return False
            missing, low, high = missing - 1, 0x80, 0xBF
        return missing > 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:  # the last lead byte
                cut -= back if self._unfinished(data[-back:]) else 0
                break
            if data[-back] < 0x80:
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Decoder:
    """Decodes ids back to text, a block at a time; unknown ids become U+FFFD."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        table = [b"\xef\xbf\xbd"] * (max(ranks.values(), default=-1) + 2)  # the last one is for all ids unknown
        for token, rank in ranks.items():
            table[rank] = token
        self.size = np.array([len(token) for token in table], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def _bytes(self, block: np.ndarray | list[int]) -> bytes:
        block, unknown = np.asarray(block, np.int64), len(self.size) - 1
        if not len(block):
            return b""
        block = np.where((block < 0) | (block > unknown), unknown, block)
        size = self.size[block]
        ends = np.cumsum(size)
        return self.bytes[np.arange(int(ends[-1])) + np.repeat(self.at[block] - ends + size, size)].tobytes()

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes known."""
        out, ids = Utf8Stream(), iter(ids)
        while block := list(islice(ids, BLOCK)):
            yield out.feed(self._bytes(block))
        yield out.finish()

    def text(self, ids: np.ndarray) -> str:
        out = Utf8Stream()
        return "".join([*(out.feed(self._bytes(ids[at : at + BLOCK])) for at in range(0, len(ids), BLOCK)), out.finish()])


def _encoder(raw: bytes, pattern: str) -> Encoder:
    return held(("encoder", hash(raw), pattern), lambda: Encoder(read_ranks(raw), pattern))


@lru_cache(maxsize=1)
def _decoder(raw: bytes) -> Decoder:
    return Decoder(read_ranks(raw))


def _raw(path: str) -> bytes:
    """The rank file, read once by the driver and sent with the tasks: it has the size of a vocabulary."""
    with open(path, "rb") as file:
        return file.read()


# Rows put into one output batch.
ROWS = 256


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] | None = None,
    decoded: str | None = None,
) -> DataFrame:
    """The columns `keep` of `docs` (all by default) and `ids`, an array of token ids of the whole text.

    Null and empty texts give an empty array. Strings that look like special tokens are ordinary
    text. With `decoded`, a column of that name has the text decoded from the ids, in the same pass.
    Columns with the names of the new ones are replaced. Rows neither move nor change their number.
    """
    raw = _raw(path)
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in (ids, decoded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = [encoder.encode(t.as_py() or "") for t in part.column(len(keep))]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int64)
                for lo, hi in _cuts(ends):
                    columns = [c.slice(lo, hi - lo) for c in part.columns[: len(keep)]]
                    columns.append(pa.ListArray.from_arrays(pa.array(ends[lo : hi + 1] - ends[lo], pa.int32()), pa.array(np.concatenate(lists[lo:hi]), pa.int32())))
                    if decoded:
                        columns.append(_texts(columns[-1], _decoder(raw)))
                    yield pa.RecordBatch.from_arrays(columns, [*names, "ids", "decoded"][: len(columns)])

    names = [f"k{i}" for i in range(len(keep))]
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)]
    schema = ", ".join([*kinds, "ids array<int>", *(["decoded string"] if decoded else [])])
    return docs.select(*keep, text).mapInArrow(run, schema).toDF(*keep, ids, *([decoded] if decoded else []))


def with_token_count(docs: DataFrame, path: str, pattern: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """`docs` with the number of token ids of each whole text as the column `count`, replaced if there; null and empty texts have none."""
    raw, keep = _raw(path), [c for c in docs.columns if c != count]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw, pattern)
        for batch in batches:
            counts = pa.array([len(encoder.encode(t.as_py() or "")) for t in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], [*names, "n"])

    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "n long"])
    return docs.select(*keep, text).mapInArrow(run, schema).toDF(*keep, count)


def _cuts(ends: np.ndarray, most: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` values each, one row at least."""
    lo, rows = 0, len(ends) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, min(hi, rows)
        lo = hi


def _texts(lists: pa.ListArray, decoder: Decoder) -> pa.Array:
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return pa.array([
        decoder.text(flat[lo:hi]) if valid else None
        for lo, hi, valid in zip(starts, starts[1:], lists.is_valid().to_pylist(), strict=False)], pa.string())


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` of `tokens` (all by default) and `text`, decoded from the ids; a null array gives null."""
    raw = _raw(path)
    keep = tuple(c for c in (tokens.columns if keep is None else keep) if c != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], _texts(part.column(len(keep)), decoder)], [*names, "text"])

    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{n} {tokens.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "text string"])
    return tokens.select(*keep, ids).mapInArrow(run, schema).toDF(*keep, text)
