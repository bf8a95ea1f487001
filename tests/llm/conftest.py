"""A small corpus with the awkward cases."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, node long, t long"


def prose(draw: random.Random, count: int, alphabet: str = "aeioulnrst") -> str:
    words = ["".join(draw.choice(alphabet) for _ in range(draw.randint(2, 8))) for _ in range(count)]
    return " ".join(words)


def corpus() -> list[tuple]:
    """Rows with exact and near copies, shared passages, periodic text, nulls, repeated rows and one long text."""
    draw = random.Random(4)
    passage, base = prose(draw, 90), prose(draw, 160).split()
    texts: list[str | None] = [None, "", " \n\t ", "one", "Two words", "a b c", "###!!", "é ü ñ ¿?", prose(draw, 4000)]
    texts += [prose(draw, draw.randint(1, 120)) for _ in range(25)]
    texts += [f"{prose(draw, 30)} {passage} {prose(draw, 20)}" for _ in range(8)] + [passage, passage + " ende"]
    for edits in (0, 1, 1, 2, 2, 3, 4, 5, 8, 12, 20, 30):
        near = list(base)
        for _ in range(edits):
            near[draw.randrange(len(near))] = prose(draw, 1)
        texts.append(" ".join(near))
    texts += [" ".join(base), " ".join(base).upper(), "la " * 200, "da di " * 90, "x" * 900, "x" * 450 + "y" * 450]
    texts += [f"line {i % 3}\n" * 12 for i in range(3)] + [texts[12]] * 5
    langs = [None if i % 11 == 0 else ("en", "de")[i % 2] for i in range(len(texts))]
    rows = [(i, t, langs[i], None if i % 13 == 0 else f"src{i % 9}", None, 0.5, "k", 1, 2) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], rows[41], (None, texts[30], "en", "src1", 3, None, None, None, None),
                   (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
