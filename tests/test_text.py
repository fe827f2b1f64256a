"""Tokens and stems against a plain re-derivation from the rules, word by word."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions.fixed import STOPWORDS, SUFFIXES_2, SUFFIXES_3, SUFFIXES_4
from lodestone.functions.text import stemmed, tokens
from lodestone.operators.text import chunk_texts


def runs(s):
    """Consonant-vowel turns of a stem."""
    kinds = "".join("v" if c in "aeiou" else "c" for c in s)
    return len(re.findall("cv", kinds))


def closed(s):
    return len(s) > 2 and s[-3] not in "aeiou" and s[-2] in "aeiou" and s[-1] not in "aeiouwxy"


def slow_stem(w):
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if runs(w[:-3]) else w
    else:
        n = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if n and any(c in "aeiou" for c in w[:-n]):
            w = w[:-n]
            if w[-2:] in ("at", "bl", "iz"):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                w = w[:-1]
            elif runs(w) == 1 and closed(w):
                w += "e"
    if w.endswith("y") and any(c in "aeiou" for c in w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((SUFFIXES_2, 0), (SUFFIXES_3, 0), (SUFFIXES_4, 1)):
        for old, new in table:
            if w.endswith(old) and runs(w[: len(w) - len(old)]) > least:
                w = w[: len(w) - len(old)] + new
                break
    if w.endswith("e") and (runs(w[:-1]) > 1 or (runs(w[:-1]) == 1 and not closed(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and runs(w) > 1:
        w = w[:-1]
    return w


WORDS = """running played happiness football companion tree see league ies ing ness bus agreed hopping falling happy relational adoption
feed bled sized hoping controlled national rationalization vileli electricity formalize hopeful goodness adjustable irritant replacement
effective activate probate rate cease roll y sky a at 2024 4x4 abcs aaa ooo yyyed glass classes""".split()


def test_stem_words(spark, small):
    vocabulary = spark.read.parquet(f"{small}/documents.parquet").select(F.explode(tokens("text")).alias("word")).distinct()
    rows = stemmed(vocabulary.union(spark.createDataFrame([(w,) for w in WORDS], "word string")), "word", "term").collect()
    assert len(rows) > 1000
    assert [(r.word, r.term, slow_stem(r.word)) for r in rows if r.term != slow_stem(r.word)] == []


@pytest.mark.parametrize(("text", "words"), [("2024/25 season", ["2024", "season"]), ("2024-25", ["2024"]), ("1998 123 3000", ["1998"]), ("x", []), ("a" * 31, []), ("Élan", ["lan"]), ("é2024/25", ["2024"]), ("", []), (None, None), ("the Running-man", ["running", "man"])])
def test_tokens(spark, text, words):
    assert spark.createDataFrame([(text,)], "t string").select(tokens("t").alias("w")).first().w == words


def test_stopwords():
    assert len(STOPWORDS) == len(set(STOPWORDS)) == 154


def test_filter_on_stems_stays_small(spark):
    """A filter on stems must not be rewritten through the layers."""
    df = stemmed(spark.createDataFrame([("running",)], "word string"), "word", "term")
    assert df.join(spark.createDataFrame([("run",)], "term string"), "term").count() == 1


def test_chunks():
    text = " ".join(f"w{i}" for i in range(301)) + ". " + " ".join(f"v{i}" for i in range(19)) + "."
    chunks = chunk_texts(text)
    assert [len(c.split()) for c in chunks] == [301]  # one sentence may be too long; a tail of 19 words goes
    assert chunk_texts("") == [] and chunk_texts("one two") == []
    assert [len(c.split()) for c in chunk_texts("\n\n".join(" ".join(["w"] * 140) for _ in range(5)))] == [280, 280, 140]
