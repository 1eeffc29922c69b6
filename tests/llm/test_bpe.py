import codecs
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from cases import no_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import bpe, queries

FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


def ranks_of(name):
    with open(P.path(name), "rb") as file:
        return bpe.read_ranks(file.read())


RANKS = {name: ranks_of(name) for name in FILES}
ENCODERS = {name: bpe.Encoder(RANKS[name], P.PATTERN) for name in FILES}
WANT = {name: tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=RANKS[name], special_tokens={}) for name in FILES}


@given(st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    for name in FILES:
        assert ENCODERS[name].encode(text).tolist() == WANT[name].encode_ordinary(text)


PIECES = ["a", "the", " ", "  ", "\n", "é", "中", "🙂", "12", "!!", "--", "===", "'s", "'ll", "ing", "tion", "क्", "ee", "aa", "<|endoftext|>"]


@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_repetitive_text(parts, times):
    text = "".join(parts) + (parts[0] * times if parts else "")
    for name in FILES:
        assert ENCODERS[name].encode(text).tolist() == WANT[name].encode_ordinary(text)


def test_small_caches_change_nothing(monkeypatch):
    for name, value in (("MOST_STATES", 50), ("MOST_PIECES", 10), ("MOST_PAIRS", 20), ("LISTED", 100)):
        monkeypatch.setattr(bpe, name, value)
    encoder, rng = bpe.Encoder(RANKS[FILES[0]], P.PATTERN), random.Random(4)
    for _ in range(100):
        text = " ".join("".join(rng.choices("etaoinsrh", k=rng.randint(1, 9))) for _ in range(30))
        assert encoder.encode(text).tolist() == WANT[FILES[0]].encode_ordinary(text)


def test_lookahead_is_bounded():
    """Output lags behind input by less than the longest token and the one before it."""
    machine = bpe.Transducer(RANKS[FILES[0]])
    longest = max(map(len, machine.tokens.values()))
    piece = "internationalizationdecontextualisationantidisestablishmentarianism" * 5
    state, read, written = machine.start, 0, 0
    for byte in piece.encode():
        state, emitted = machine.step(state, byte)
        read, written = read + 1, written + sum(len(machine.tokens[t]) for t in emitted)
        assert read - written <= 2 * longest


def test_arcs_are_built_the_second_time():
    machine, want = bpe.Transducer(RANKS[FILES[0]]), WANT[FILES[0]]
    for piece in (" inhaenlyxq", "antidisestablishmentarianism", "zzzzzzzzzzzz", "Übergrößenträger"):
        met = []
        for _ in range(len(piece.encode()) + 3):
            assert machine.encode(piece.encode()) == want.encode_ordinary(piece)
            met.append(len(machine.states))
        assert met[0] <= met[-1] == met[-2]


@given(st.binary(max_size=60), st.lists(st.integers(0, 60), max_size=8))
@settings(max_examples=500, deadline=None)
def test_stream_decodes_like_the_whole(data, cuts):
    machine, want = bpe.Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace")
    cuts = sorted({0, len(data), *(c for c in cuts if c < len(data))})
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        assert machine.feed(data[lo:hi]) == want.decode(data[lo:hi])
    assert machine.finish() == want.decode(b"", final=True)


@given(st.text(max_size=50), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_round_trip_in_blocks(text, size):
    ids, decoder = ENCODERS[FILES[0]].encode(text).tolist(), bpe.Decoder(RANKS[FILES[0]])
    machine = bpe.Utf8Stream()
    out = [machine.feed(decoder._bytes(ids[i : i + size])) for i in range(0, len(ids), size)]
    assert "".join([*out, machine.finish()]) == text == "".join(decoder.stream(ids))


def test_unknown_ids():
    assert "".join(bpe.Decoder(RANKS[FILES[0]]).stream([-1, 10**6, 64])) == "��" + RANKS_TEXT(64)


def RANKS_TEXT(rank):
    return next(t for t, r in RANKS[FILES[0]].items() if r == rank).decode()


def test_query_against_tiktoken(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.QUERIES["op5_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = WANT[FILES[0]].encode_ordinary(docs.pop(r["doc_id"]))
        text = WANT[FILES[0]].decode(ids)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(text))
    assert not docs


def test_odd_documents(spark):
    docs = odd_docs(spark).withColumnRenamed("size", "ids")
    path = P.path(FILES[0])
    encoded = bpe.encode(docs, path, P.PATTERN, decoded="back")
    for r in encoded.collect():
        assert r["ids"] == WANT[FILES[0]].encode_ordinary(r["text"] or "") and r["back"] == (r["text"] or "")
    again = bpe.decode(encoded, path, text="back").collect()
    assert len(again) == 13 and all(r["back"] == (r["text"] or "") for r in again)
    assert bpe.encode(no_docs(spark), path, P.PATTERN).collect() == []
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert bpe.decode(nothing, path).collect()[0]["text"] is None


def test_table_without_a_byte():
    with pytest.raises(AssertionError):
        bpe.Transducer({b"a": 0, b"b": 1}).encode(b"abc")
