import random

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small(spark):
    """doc_id and text of the smallest documents table."""
    return spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with names operators use."""
    rows = [
        (1, "one two three four five six", "en", 27),
        (1, "one two three four five six", "en", 27),
        (2, None, None, None),
        (3, "", "fr", 0),
        (None, "lost id with a few words here", "en", 5),
        (None, None, None, None),
        (5, "…  12 34", None, 9),
        (6, "mot " * 40_000, "fr", 160_000),
        (7, "one two three four five six", "de", 27),
    ]
    return spark.createDataFrame(
        [(*row, "x", 3, "k", 1) for row in rows],
        "doc_id long, text string, lang string, n_chars long, score string, n int, key string, spans int",
    )


def invented(seed: int, n: int = 60) -> list[tuple[int, str]]:
    """Texts with exact and near copies and shared passages."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeimnorst") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    passage = " ".join(draw.choice(words) for _ in range(90))
    texts: list[str] = []
    for _ in range(n):
        kind = draw.random()
        if texts and kind < 0.2:
            texts.append(draw.choice(texts))
        elif texts and kind < 0.5:
            old = draw.choice(texts).split(" ")
            for _ in range(max(1, len(old) // draw.choice([15, 40, 100]))):
                old[draw.randrange(len(old))] = draw.choice(words)
            texts.append(" ".join(old))
        else:
            own = [draw.choice(words) for _ in range(draw.randint(0, 160))]
            if kind > 0.8:
                own.insert(len(own) // 2, passage)
            texts.append(" ".join(own))
    return list(enumerate(texts))
