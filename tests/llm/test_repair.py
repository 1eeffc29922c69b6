import hashlib
import itertools
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import compare, views

from pageloom.llm import queries, repair
from pageloom.llm.repair import BLANK, CUT, DUPLICATE, SOUND, Row

TURNS = "conv_id long, turn long, role string, text string, key string, piece int, at long, part string"


def by_trying_all(rows, most=3):
    """The least (cost, audit) of all edit sequences with at most `most` insertions, told by the roles they give."""
    best = None
    for letters in all_letters(len(rows), most):
        for roles in told(letters, rows):
            if good(roles[1]) and (best is None or (roles[0], letters) < best):
                best = (roles[0], letters)
    return best


def all_letters(n, most):
    for inserts in range(most + 1):
        for places in itertools.combinations(range(n + inserts), inserts):
            for rest in itertools.product("DKR", repeat=n):
                it = iter(rest)
                yield "".join("I" if i in places else next(it) for i in range(n + inserts))


def told(letters, rows):
    """(cost, role initials) of every choice of roles for the letters."""
    ways, left = [(0, "")], iter(rows)
    for letter in letters:
        row = None if letter == "I" else next(left)
        if letter == "I":
            ways = [(c + 5, s + x) for c, s in ways for x in "ua"]
        elif letter == "D":
            ways = [(c + 2, s) for c, s in ways]
        elif row.fault in (BLANK, DUPLICATE):
            return []
        else:
            more = 5 if row.fault == CUT else 0
            ways = [(c + more, s + row.initial) for c, s in ways] if letter == "K" else [(c + more + 1, s + x) for c, s in ways for x in "ua"]
    return ways


def good(roles):
    rest = roles.removeprefix("s")
    return roles == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def test_agenda_by_trying_all():
    chance = random.Random(5)
    for _ in range(150):
        rows = [Row(chance.choice("ssuuuaaax"), chance.choice([SOUND] * 5 + [BLANK, DUPLICATE, CUT])) for _ in range(chance.randint(0, 5))]
        found = repair.lightest(rows, repair.START)
        assert min(found[q] for q in repair.ACCEPTED if q in found) == by_trying_all(rows, 2 if len(rows) > 3 else 3)


def test_pieces_join_to_the_whole():
    chance = random.Random(7)
    for _ in range(200):
        rows = [Row(chance.choice("sua"), chance.choice([SOUND, SOUND, BLANK, CUT])) for _ in range(chance.randint(1, 40))]
        whole, ways, at = repair.lightest(rows, repair.START), {repair.START: (0, "")}, 0
        while at < len(rows):
            some = rows[at : at + chance.randint(1, 9)]
            piece = {(entry, exit_): way for entry in repair.FOLLOWING for exit_, way in repair.lightest(some, entry).items()}
            ways, at = {exit_: way for exit_, (way, _) in repair.joined(ways, piece).items()}, at + len(some)
        assert ways == whole


def slow(rows):
    """One conversation's row of the result, from (turn, role, text) of its rows."""
    rows = sorted(((t is not None, t, r or "", (x or "")) for t, r, x in rows), key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
    seen, judged = set(), []
    for _, _, role, text in rows:
        bare = text.encode().strip()
        fault = BLANK if not bare else DUPLICATE if (role, text) in seen else SOUND if bare[-1:] in (b".", b"!", b"?") else CUT
        seen.add((role, text))
        judged.append(Row(role[:1], fault))
    found = repair.lightest(judged, repair.START)
    cost, audit = min(found[q] for q in repair.ACCEPTED if q in found)
    turns = [t for _, t, _, _ in rows if t is not None]
    faults = [j.fault for j in judged]
    illegal = sum(a.initial + b.initial not in repair.LEGAL for a, b in zip(judged, judged[1:], strict=False))
    out = "\n".join(repair.apply(audit, repair.START, [(r, x) for _, _, r, x in rows]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal,
            cost, audit, hashlib.sha256(out.encode()).hexdigest())


@pytest.mark.parametrize("piece", [1, 2, 8])
def test_odd_conversations(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    chance = random.Random(piece)
    rows = [(1, 0, "system", "be kind."), (1, 1, "user", "hello."), (1, 2, "assistant", "hi there"), (1, 9, "assistant", "hi."), (1, 9, "assistant", "hi."),
            (2, None, None, None), (2, None, "user", "a."), (2, 3, "", "b."), (3, 0, "user", " \t\n"), (None, 0, "user", "x?"), (None, 1, "assistant", "y!\n"),
            (4, 5, "robot", "beep."), (5, 0, "assistant", "é" * 5000 + ".")]
    rows += [(6, i // 2, chance.choice(["user", "assistant", "system"]), chance.choice(["yes.", "no", "", f"turn {i}."])) for i in range(300)]
    frame = spark.createDataFrame([(*r, "k", 1, 2, "p") for r in rows], TURNS).repartition(3)
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(frame).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv in found:
        assert found[conv] == slow([r[1:] for r in rows if r[0] == conv])


def test_no_conversations(spark, tmp_path):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repair(empty).collect() == []
    empty.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_repair(spark, str(tmp_path)).collect() == []


def test_query_with_nulls_by_sql(spark, tmp_path):
    roles, texts = ["system", "user", "assistant", None, "other"], ["Good.", "so", None, "", "Why? Yes!", "a b."]
    chance = random.Random(3)
    rows = [(c or None, t if t < 9 else None, chance.choice(roles), chance.choice(texts)) for c in range(60) for t in range(chance.randint(1, 11))]
    conv, turn, role, text = zip(*rows, strict=True)
    columns = {"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": role, "text": text}
    pq.write_table(pa.table(columns), f"{tmp_path}/conversations.parquet")
    good_, note = compare(spark, views(str(tmp_path)), "op12_repair", str(tmp_path), queries.op12_repair, queries.SQL["op12_repair"])
    assert good_, note
