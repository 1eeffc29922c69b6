"""Frames every operator must stand: nulls, empty and long texts, repeated rows, clashing column names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _salt int, id string, fp long, begin string, root string, size long"

LONG = "lorem ipsum dolor " * 60_000


def odd_docs(spark):
    rows = [
        (1, "The cat sat on the mat.", "en", "a"), (1, "The cat sat on the mat.", "en", "a"), (2, "the CAT sat on the mat.", None, None),
        (3, None, None, None), (None, "the cat sat on the mat.", "en", "b"), (None, None, "de", "b"), (4, "", "de", "b"), (5, " \t\n", None, "c"),
        (6, LONG, "la", "c"), (7, LONG.upper(), "la", "c"), (8, "Éa ß 中文 🙂 <|im_end|>", "fr", "a"), (9, "123 +-*/", "en", "a"),
        (9, "other text with the same id", "en", "a")]
    return spark.createDataFrame([(*r, 7, 1, "x", 2, "y", "z", 3) for r in rows], DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return (text or "").encode().lower()
