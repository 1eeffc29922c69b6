import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import bpe, chat, queries

NASTY = st.text(alphabet="<|\\>\nn im_start|endé", max_size=30)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(turns):
    text = "".join(chat.render(role, said)[0] for role, said in turns)
    assert list(chat.parse(text)) == turns
    for role, said in turns:
        whole, head = chat.render(role, said)
        assert chat.unescape(whole[head : -len(chat.END) - 1]) == said and "<|" not in chat.escape(said)


VOCABULARY = P.path(queries.VOCABULARY)
with open(VOCABULARY, "rb") as file:
    TOKENS = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(file.read()), special_tokens={})


def tokens_of(turn):
    """Tokens of a turn as it is written: begin, role, line end, text, end, line end."""
    role, text = turn
    return len(TOKENS.encode_ordinary(chat.escape(role).replace("\n", "\\n"))) + len(TOKENS.encode_ordinary(chat.escape(text))) + 4


def bytes_of(turn):
    role, text = turn
    return len((chat.escape(role).replace("\n", "\\n") + chat.escape(text)).encode()) + 4


def windows_of(spark, turns, budget, history, segment, monkeypatch, **more):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, seg int")
    found = chat.format_windows(frame, budget, history, **more).collect()
    return sorted(found, key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["segment"], r["number"]))


@pytest.mark.parametrize(("budget", "history", "segment", "real"), [
    (1000, 100, 64, True), (60, 30, 1, True), (60, 30, 3, True), (40, 0, 2, True), (5, 50, 1, True), (1000, 100, 64, False), (200, 90, 1, False)])
def test_windows(spark, monkeypatch, budget, history, segment, real):
    turns = [(1, 0, "system", "be kind", 0)]
    turns += [(1, i, ("user", "assistant")[i % 2], f"turn {i} " + "x" * (i * 7 % 90), 0) for i in range(1, 80)]
    turns += [(2, 0, "user", "<|im_end|>\\", 0), (2, 1, "assistant", None, 0), (2, 1, "assistant", None, 0), (None, None, None, "lost", 0), (3, 0, "system", "only", 0)]
    found = windows_of(spark, turns, budget, history, segment, monkeypatch, **({"vocabulary": VOCABULARY, "pattern": P.PATTERN} if real else {}))
    size = tokens_of if real else bytes_of
    for conv in (1, 2, None, 3):
        want = [(r or "", t or "") for c, _, r, t, _ in turns if c == conv]
        own = [w for w in found if w["conv_id"] == conv]
        assert [t for w in own for t in chat.new_turns(w["text"], w["n_repeated"])] == want
        targets = [chat.unescape(w["text"][s["start"] : s["end"]]) for w in own for s in w["loss"]]
        assert targets == [t for r, t in want if r == "assistant"]
        at = 0
        for w in own:
            parsed = list(chat.parse(w["text"]))
            repeated, new = parsed[: w["n_repeated"]], parsed[w["n_repeated"] :]
            if want[0][0] == "system" and at:
                assert repeated[0] == want[0]
                repeated = repeated[1:]
            assert repeated == want[at - len(repeated) : at]
            assert sum(map(size, repeated)) <= max(history, 0)
            lead = size(want[0]) if want[0][0] == "system" and at else 0
            assert w["n_tokens"] == sum(map(size, parsed))
            assert w["n_tokens"] <= budget or w["n_tokens"] == lead + size(new[0]) or (len(new) <= 2 and not at)
            at += len(new)


def test_budget_holds_in_real_tokens(spark):
    """Of the given table; more than the budget only where the system turn and the first new one alone have more."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    over = 0
    for w in chat.format_windows(turns, vocabulary=VOCABULARY, pattern=P.PATTERN).collect():
        parsed = list(chat.parse(w["text"]))
        assert w["n_tokens"] == sum(map(tokens_of, parsed))
        new = parsed[w["n_repeated"]:]
        least = [t for t in (parsed[0], new[0]) if t[0] == "system" or t is new[0]]
        assert w["n_tokens"] <= chat.BUDGET or w["n_tokens"] <= sum(map(tokens_of, least)) or len(new) == 1 or new[0][0] == "system"
        over += w["n_tokens"] > chat.BUDGET
    assert over < 5


def test_query_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-1: [("user", queries.TRICKY), ("assistant", queries.TRICKY)]}
    for r in rows:
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = {r["conv_id"]: r for r in queries.QUERIES["op4_chat"](spark, sf_dir).collect()}
    assert set(found) == set(want)
    for conv, turns in want.items():
        r, loss = found[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss)) and r["formatted_chars"] > 0


def test_no_turns(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_windows(frame).filter(F.lit(True)).collect() == []
