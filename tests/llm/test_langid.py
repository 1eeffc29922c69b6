import itertools

import numpy as np
from cases import no_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import langid, queries

SCORES = st.integers(1, 7).flatmap(lambda n: st.lists(st.lists(st.integers(-8, 0), min_size=3, max_size=3), min_size=n, max_size=n))


def worth(scores, path, penalty):
    return sum(scores[i][k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))


@given(SCORES, st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_viterbi_is_the_best_labelling(scores, penalty):
    best = max(worth(scores, path, penalty) for path in itertools.product(range(3), repeat=len(scores)))
    table = np.array(scores, float)
    assert worth(scores, langid.viterbi(table, penalty), penalty) == best
    top = int(table.sum(axis=0).argmax())
    if langid.constant(table, top, penalty):
        assert worth(scores, [top] * len(scores), penalty) == best


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    found = queries.QUERIES["op6_langid"](spark, sf_dir).join(docs, "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == docs.count() and 200 < len(held) < 300
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


TRAIN = [(0, "the cat and the dog went to the house with them", "en"), (1, "der Hund und die Katze gehen in das Haus", "de"),
         (3, "это простой текст о собаке и кошке", "ru"), (4, "那只猫和狗", "zh")] * 20


def small_model(spark):
    return langid.fit(spark.createDataFrame([(i, t, name) for i, (_, t, name) in enumerate(TRAIN)], "doc_id long, text string, lang string"))


def test_spans_of_mixed_text(spark):
    model = small_model(spark)
    seen = {name: np.flatnonzero(model.seen[i]).tolist() for i, name in enumerate(langid._NAMES)}
    assert model.languages == ["de", "en", "ru", "zh"] and seen["Cyrillic"] == [2] and seen["Latin"] == [0, 1]
    english, german = "the dog and the cat went to the house with the dog ", "der Hund und die Katze gehen in das Haus und die Katze"
    name, score, spans = langid.Labeller(model, 3.0).label([english + german])[0]
    assert name in ("de", "en") and 0.4 < score < 0.7
    assert spans == [(0, len(english), "en"), (len(english), len(english + german), "de")]
    assert [f[0] for f in langid.Labeller(model).label(["собака", None, "猫 狗", "", "12"])] == ["ru", "und", "zh", "und", "und"]


def test_scripts_leave_out_other_languages(spark):
    [scores] = small_model(spark).scores(langid.words_of("собака"))
    assert scores[2] > langid.FLOOR and (np.delete(scores, 2) == langid.FLOOR).all()


def test_odd_documents(spark):
    model = small_model(spark)
    found = langid.identify(odd_docs(spark), model).select("doc.doc_id", "doc._salt", "doc.text", "lang", "score").collect()
    assert len(found) == 13 and {r["_salt"] for r in found} == {1}
    for r in found:
        assert (r["lang"] == langid.UNKNOWN) == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    assert langid.identify(no_docs(spark), model).collect() == []
    nothing = langid.fit(no_docs(spark))
    assert nothing.languages == [] and {r["lang"] for r in langid.identify(odd_docs(spark), nothing).collect()} == {langid.UNKNOWN}
    assert langid.Labeller(model).label(["²³ _ 5"])[0][0] == langid.UNKNOWN


def test_blocks_change_nothing(spark, monkeypatch):
    """Texts are decided alike whether scored together, alone or in pieces."""
    model = small_model(spark)
    texts = ["the dog and the cat went to the house with the dog der Hund und die Katze gehen in das Haus " * 30, None, "İé ab", "x", "", "der Hund", "собака the"] * 3
    whole = langid.Labeller(model, 3.0).label(texts)
    monkeypatch.setattr(langid, "BLOCK", 4)
    assert langid.Labeller(model, 3.0).label(texts) == whole == [langid.Labeller(model, 3.0).label([t])[0] for t in texts]


@given(st.text(alphabet="aBé1 \n²İ中", max_size=40))
@settings(max_examples=200, deadline=None)
def test_words(text):
    import re

    words = langid.words_of(text)
    want = [(m.start(), m.end()) for m in re.finditer(r"[aBéİ中]+", text)]
    assert list(zip(words.starts.tolist(), words.ends.tolist(), strict=True)) == want
    lengths = [hi - lo for lo, hi in want]
    for order, buckets in zip(langid.ORDERS, words.buckets, strict=True):
        kept = words.owner[buckets < langid.BUCKETS]
        assert np.bincount(kept, minlength=len(want)).tolist() == [max(0, n + 3 - order) for n in lengths]


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).select("id", langid.held_out(F.col("id")).alias("held")).collect()
    assert all(r["held"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_fit_on_letters_that_lower_case_to_two(spark):
    rows = [(i, "İstanbul ve İzmir güzel", "tr") for i in range(8)] + [(10 + i, "the cat and the dog", "en") for i in range(8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [f[0] for f in langid.Labeller(model).label(["İstanbul", "the dog"])] == ["tr", "en"]
    [tr] = langid.words_of("İstanbul").buckets[0][:1]
    assert model.table[tr, 1] > model.table[tr, 0]


def slow_label(model, text):
    """The text's language and score, word by word and gram by gram, from the model's table."""
    import re

    words = [m for m in re.finditer(r"[^\W\d_]+", text or "") if all(c.isalpha() for c in m[0])]
    if not words or not model.languages:
        return langid.UNKNOWN, 0.0
    k, scores = len(model.languages), []
    for m in words:
        padded = [0, *(ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in m[0]), 0]
        fit = np.zeros(k)
        for order in langid.ORDERS:
            for at in range(len(padded) - order + 1):
                h = order * 0x9E3779B1 & 0xFFFFFFFF
                for point in padded[at : at + order]:
                    h = (h ^ point) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 13
                fit += model.table[h % langid.BUCKETS]
        script = next((name for lo, hi, name in langid.SCRIPTS if lo <= ord(m[0][0]) <= hi), "other")
        seen = model.seen[langid._NAMES.index(script)]
        if seen.any():
            fit[~seen] = -np.inf
        fit -= fit.max()
        scores.append(np.maximum(fit - np.log(np.exp(fit).sum()), langid.FLOOR))
    best = {j: (scores[0][j], [j]) for j in range(k)}
    for row in scores[1:]:
        top = max(best, key=lambda j: (best[j][0], -j))
        step = {}
        for j in range(k):
            value, path = best[j] if best[j][0] >= best[top][0] - langid.PENALTY else (best[top][0] - langid.PENALTY, best[top][1])
            step[j] = (value + row[j], [*path, j])
        best = step
    path = best[max(best, key=lambda j: (best[j][0], -j))][1]
    letters = np.bincount(path, [m.end() - m.start() for m in words], k)
    return model.languages[int(letters.argmax())], float(letters.max() / letters.sum())


def test_query_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found, mixed = queries.QUERIES["op6_langid"](spark, sf_dir).collect(), 0
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        if len(texts[r["doc_id"]] or "") < 6000:
            name, score = slow_label(model, texts[r["doc_id"]])
            assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-9
            mixed += score < 1
    both = " ".join((texts[a] or "")[:400] for a in list(texts)[:12])  # texts of several languages
    name, score, _ = langid.Labeller(model).label([both])[0]
    assert (name, score) == slow_label(model, both) and score < 1
