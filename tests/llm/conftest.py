from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, component string, row string, rep string, digest string"


def odd_rows(seed: int = 1) -> list[tuple]:
    """Documents with every awkward case: nulls, empty and long texts, repeats, ties, near copies."""
    r = random.Random(seed)
    words = ["the", "of", "Tree", "été", "größe", "x1", "niño", "stone", "river", "blue", "run", "idiot", "中文", "<|endoftext|>", "it's"]
    body = lambda n: " ".join(r.choice(words) + (r.choice(["", "", ".", "\n"])) for _ in range(n))
    texts = [None, "", "  \n\t ", "one", "one two", "ONE two", "same words here", "same words here", body(9000)]
    base = [w for w in body(300).split()]
    for k in range(6):  # near copies of one text
        v = list(base)
        v[k * 17] = "changed"
        texts.append(" ".join(v))
    texts += [body(r.randint(1, 120)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 0, -1, 0.5, "c", "r", "p", "d") for i, t in enumerate(texts)]
    rows += rows[3:6]  # repeated rows
    rows += [(None, "no id here", "en", "s1", 0, -1, 0.5, "c", "r", "p", "d"), (None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
