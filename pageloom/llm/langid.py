"""Language spans: scripts narrow the candidates of a word, Viterbi with a switching penalty labels words.

A word's score for a language is its log posterior under character n-grams, hashed into a table of
fixed size. Only languages seen in the word's script are candidates. The best labelling pays a
penalty for every change of language between words; the language with most letters is the text's.
Texts are scored many at a time as arrays of code points, so no step looks at words one by one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import held

UNKNOWN = "und"
# Hashed features per language: with the number of languages, a bound on the size of the model.
BUCKETS = 1 << 16
MOST_LANGUAGES = 1000
# Texts per language the model is fitted on: a bounded sample, chosen by a hash of the id.
SAMPLE = 4000
# Log cost of a change of language between two words, and the least log posterior of one word.
PENALTY, FLOOR = 12.0, -8.0
# Lengths of the n-grams; the ends of a word count as characters.
ORDERS = (2, 3, 4)
# Characters scored at a time, times languages: bounds memory.
BLOCK = 1 << 19

# First and last code point of the main blocks of each script.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x309F, "Kana"), (0x30A0, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"), (0xFF21, 0xFF5A, "Latin"),
    (0x20000, 0x3134F, "Han"),
)
_FIRST = [first for first, _, _ in SCRIPTS]
_NAMES = ["other", *dict.fromkeys(name for _, _, name in SCRIPTS)]
CODE_POINTS = 0x110000


class Alphabet:
    """What is known of code points, looked up by array: filled in as they are met."""

    def __init__(self) -> None:
        self.known = np.zeros(CODE_POINTS, bool)
        self.letter = np.zeros(CODE_POINTS, bool)
        self.lower = np.zeros(CODE_POINTS, np.uint32)
        self.script = np.zeros(CODE_POINTS, np.uint8)

    def read(self, text: str) -> np.ndarray:
        """The code points of `text`."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for point in np.unique(points[~self.known[points]]).tolist():
            char = chr(point)
            at = bisect_right(_FIRST, point) - 1
            inside = at >= 0 and point <= SCRIPTS[at][1]
            self.known[point], self.letter[point] = True, char.isalpha()
            self.lower[point] = ord(char.lower()) if len(char.lower()) == 1 else point
            self.script[point] = _NAMES.index(SCRIPTS[at][2]) if inside else 0
        return points


def alphabet() -> Alphabet:
    return held("alphabet", Alphabet)


@dataclass
class Words:
    """The letter runs of a text: where they begin and end, their script, and the features of each.

    `buckets[k]` holds a feature per place in `owner`; places that have none of that order hold BUCKETS.
    """

    starts: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    firsts: np.ndarray  # of each word, its first place
    owner: np.ndarray  # of each place, its word
    buckets: list[np.ndarray]


def words_of(text: str) -> Words:
    known = alphabet()
    points = known.read(text)
    letter = np.zeros(len(points) + 2 + max(ORDERS), bool)  # position i of the text is at i + 1
    letter[1 : len(points) + 1] = known.letter[points]
    codes = np.zeros(len(letter), np.uint32)
    codes[1 : len(points) + 1] = np.where(letter[1 : len(points) + 1], known.lower[points], 0)
    after = letter[1:]
    before = np.flatnonzero(after & ~letter[:-1])  # the place before each word's first letter
    last = np.flatnonzero(letter[:-1] & ~after)
    places = np.flatnonzero(letter[:-1] | after)
    begins = after[places] & ~letter[places]
    buckets, inside = [], np.ones(len(places), bool)
    for order in ORDERS:
        if order > 2:  # only the ends of a gram may lie outside the word
            inside = inside & letter[places + order - 2]
        mixed = np.full(len(places), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            mixed = (mixed ^ codes[np.minimum(places + k, len(codes) - 1)]) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
        buckets.append(np.where(inside, mixed % np.uint32(BUCKETS), BUCKETS))
    return Words(before, last, known.script[points[before]], np.flatnonzero(begins), np.cumsum(begins) - 1, buckets)


@dataclass
class Model:
    """Log likelihood of each bucket by language (a last row of zeros), and the languages seen in each script."""

    languages: list[str]
    table: np.ndarray
    seen: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Log posterior of the candidate languages of each word, FLOOR at least; others get FLOOR."""
        if not len(words.firsts) or not self.languages:
            return np.empty((len(words.firsts), len(self.languages)))
        fit = sum(self.table[b] for b in words.buckets)
        fit = np.add.reduceat(fit, words.firsts, axis=0, dtype=np.float64)
        seen = self.seen[words.scripts]
        fit = np.where(seen | ~seen.any(axis=1, keepdims=True), fit, -np.inf)
        fit -= fit.max(axis=1, keepdims=True)
        return np.maximum(fit - np.log(np.exp(fit).sum(axis=1, keepdims=True)), FLOOR)


def constant(scores: np.ndarray, top: int, penalty: float) -> bool:
    """Whether staying with `top` throughout is a best labelling.

    It is when no other language gains more than the penalty on any stretch, and the best gains on a
    first and a last stretch together do not either: a labelling of k stretches pays for k - 1 changes,
    and gains on k - 1 of them, or on all with only the first and the last at the ends.
    """
    gain = np.cumsum(scores - scores[:, top : top + 1], axis=0)
    lowest = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
    lowest[1:] = lowest[:-1].copy()
    lowest[0] = 0.0
    ends = max(gain.max(), 0.0) + max((gain[-1] - lowest).max(), 0.0)
    return bool((gain - lowest).max() <= penalty and ends <= penalty)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labelling with the highest sum of scores less `penalty` per change; ties stay, then go to the first."""
    n, k = scores.shape
    back, best = np.empty((n, k), np.int32), scores[0].copy()
    own = np.arange(k)
    back[0] = own
    for i in range(1, n):
        top = int(best.argmax())
        switch = best[top] - penalty
        stay = best >= switch
        back[i] = np.where(stay, own, top)
        best = np.where(stay, best, switch) + scores[i]
    path = np.empty(n, np.int32)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


@dataclass
class Labeller:
    """Labels texts, many at a time."""

    model: Model
    penalty: float = PENALTY

    def _pieces(self, text: str) -> Iterator[tuple[int, str]]:
        """`text` in pieces of bounded size that cut no word, with their offsets."""
        size, at = max(1024, BLOCK // max(1, len(self.model.languages))), 0
        while at < len(text):
            end = min(len(text), at + size)
            while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
                end += 1
            yield at, text[at:end]
            at = end

    def _decide(self, text: str, starts: np.ndarray, lengths: np.ndarray, scores: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]]]:
        if not len(starts) or not self.model.languages:
            return UNKNOWN, 0.0, []
        names = self.model.languages
        top = int(scores.sum(axis=0).argmax())
        if constant(scores, top, self.penalty):
            return names[top], 1.0, [(0, len(text), names[top])]
        path = viterbi(scores, self.penalty)
        letters = np.bincount(path, lengths, len(names))
        turns = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
        cuts = [0, *starts[turns[1:]].tolist(), len(text)]
        spans = [(lo, hi, names[path[t]]) for lo, hi, t in zip(cuts, cuts[1:], turns, strict=False)]
        best = int(letters.argmax())
        return names[best], float(letters[best] / letters.sum()), spans

    def _long(self, text: str) -> tuple[str, float, list[tuple[int, int, str]]]:
        parts = []
        for at, piece in self._pieces(text):
            words = words_of(piece)
            parts.append((words.starts + at, words.ends - words.starts, self.model.scores(words)))
        return self._decide(text, *(np.concatenate(p) for p in zip(*parts, strict=True)))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of the letters in its spans, spans of (start, end, language) in characters) of each text."""
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        size, group, length = max(1024, BLOCK // max(1, len(self.model.languages))), [], 0
        for i, text in enumerate([*texts, None]):
            if group and (i == len(texts) or length + len(text or "") > size):
                self._group(texts, group, out)
                group, length = [], 0
            if text and len(text) > size:
                out[i] = self._long(text)
            elif text:
                group.append(i)
                length += len(text) + 1
        return out

    def _group(self, texts: list[str | None], group: list[int], out: list) -> None:
        """Score the texts as one, parted by line ends, and decide each."""
        words = words_of("\n".join(texts[i] for i in group))
        scores, at = self.model.scores(words), 0
        offsets = np.cumsum([0, *(len(texts[i]) + 1 for i in group)])
        bounds = np.searchsorted(words.starts, offsets)
        for n, i in enumerate(group):
            lo, hi = bounds[n], bounds[n + 1]
            out[i] = self._decide(texts[i], words.starts[lo:hi] - offsets[n], words.ends[lo:hi] - words.starts[lo:hi], scores[lo:hi])


# --- Spark

def held_out(doc_id: Column, remainder: int = 2, parts: int = 4) -> Column:
    """Whether an id is kept from training: by the CRC-32 of its decimal text."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts == remainder, F.lit(False))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of `labelled`, fitted on about `sample` texts per language chosen by a hash of the id.

    Rows without text or language are left out. What comes to the driver is a count per language
    and bucket (at most BUCKETS x MOST_LANGUAGES) and per language and script.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("id")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    assert len(sizes) <= MOST_LANGUAGES, "more languages than the model may hold"
    languages = sorted(sizes)
    if not languages:
        return Model([], np.empty((BUCKETS + 1, 0), np.float32), np.empty((len(_NAMES), 0), bool))
    shares = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, sample / sizes[name]))))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(chance < F.element_at(shares, F.col("lang")))
    words = chosen.select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    words = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))  # words_of() lower-cases as in scoring
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((len(languages), BUCKETS + 1)), np.zeros((len(languages), len(_NAMES)))
        for batch in batches:
            rows = batch.column(1).to_pylist()
            words, ends = words_of("\n".join(rows)), np.cumsum([len(x) + 1 for x in rows])
            row = np.searchsorted(ends, words.starts, "right")  # of each word, also where a row has none or several
            name, weight = np.array([number[x] for x in batch.column(0).to_pylist()])[row], batch.column(2).to_numpy()[row]
            for language in range(len(languages)):
                own = name == language
                seen[language] += np.bincount(words.scripts[own], weight[own], len(_NAMES))
                here = own[words.owner]
                for buckets in words.buckets:
                    counts[language] += np.bincount(buckets[here], weight[words.owner[here]], BUCKETS + 1)
        table = np.concatenate([counts[:, :BUCKETS], seen], axis=1)
        column, cell = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.int32()), pa.array(cell, pa.int32()), pa.array(table[column, cell])], ["lang", "cell", "n"])

    found = words.mapInArrow(run, "lang int, cell int, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(languages), BUCKETS + len(_NAMES)))
    table[found.column("lang").to_numpy(), found.column("cell").to_numpy()] = found.column("n").to_numpy()
    counts = table[:, :BUCKETS].T
    likelihood = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS))
    likelihood = np.concatenate([likelihood, np.zeros((1, len(languages)))]).astype(np.float32)
    return Model(languages, likelihood, table[:, BUCKETS:].T > 0)


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(doc: a struct of the row, lang, score, spans) for every row of `docs`.

    `lang` is the language with most letters, `und` for null texts and those without a letter;
    `score` its share of the letters, 0 for `und`; `spans` cover the text by (start, end, lang).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        for batch in batches:
            found = labeller.label(batch.column(1).to_pylist())
            spans = pa.array([[{"start": a, "end": b, "lang": name} for a, b, name in f[2]] for f in found],
                             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans],
                ["doc", "lang", "score", "spans"])

    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, lang string, score double, spans array<struct<start:int,end:int,lang:string>>")
