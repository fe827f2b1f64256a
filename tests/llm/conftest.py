import random

import pytest

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(LOREM) + rng.choice(["", "", "s", "ing", str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids that repeat, columns with clashing names."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(1, 300)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "s", 0), (62, " \t\n\x0b\x0c\r ", "en", "s", 6), (None, "a null id with some words", "en", "s", 3), (None, None, None, None, None)]
    rows += [(63, sentence(rng, 40_000), "en", "s", 1), (64, "x" * 200_000, "en", "s", 1), (65, "é日本 😀 <|endoftext|> İI ΑΣ a@b.co +1 (555) 123-4567", "en", "s", 1)]
    rows += [rows[3], rows[3], (3, "another text under an id that is there", "en", "s", 1), (66, rows[7][1], "en", "s", 1), (67, rows[7][1].upper(), "en", "s", 1)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    clash = ", ".join(f"{c} int" for c in ("kept", "fp", "n_words", "spans", "document", "id", "row", "held", "rank", "n_tokens", "component_id", "bucket", "task", "words"))
    return spark.createDataFrame([(*r, *[7] * 14) for r in rows], f"{names}, {clash}").repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1, None, None), (41, 5, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
