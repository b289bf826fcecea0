"""Small document tables with the awkward cases: nulls, empty and long texts, repeated rows, further columns."""

import random

import pytest

SYLLABLES = ["the", "of", "and", "er", "ing", "ton", "la", "der", "é", "un", "re", "sto"]


def prose(seed: int, words: int) -> str:
    chance = random.Random(seed)
    return " ".join("".join(chance.choices(SYLLABLES, k=chance.randint(1, 3))) + chance.choice(["", "", ",", ".\n"]).strip(" ") for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    plain = {k: prose(k, 30 + 7 * k) for k in range(40)}
    near = plain[5].split(" ")
    near[3] = "changed"
    return [
        *plain.items(),
        (100, plain[3]), (101, plain[3]), (102, " ".join(near)), (103, None), (104, ""), (105, "   \n\t "), (106, "word"),
        (107, "same words again " * 60), (108, prose(9, 9000)), (109, "x" * 70_000), (None, plain[7]), (None, None),
        (110, "a  b   c\n\n d\t"), (111, "<|endoftext|> in a text ▁ sign"), (112, "line one\nline one\n" * 30), (112, "line one\nline one\n" * 30),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if n % 3 else None, f"src{n % 4}", None if t is None else len(t), "mine") for n, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
