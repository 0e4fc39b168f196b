import hashlib
import random
import re

import pytest

from paperlake.llm import decontaminate
from paperlake.llm.queries import QUERIES

from .conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=13):
    """Sorted rows of what the operator should say."""
    marks: dict[tuple, set] = {}
    for item_id, text in items:
        own = words(text)
        n = min(window, len(own))
        for at in range(len(own) - n + 1 if own else 0):
            marks.setdefault(tuple(own[at : at + n]), set()).add(item_id)
    sizes = {len(mark) for mark in marks}
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for n in sizes:
            for at in range(len(own) - n + 1):
                if ids := marks.get(tuple(own[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= ids
        listed = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(listed), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_production_query(spark, small):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    wanted = brute(small.itertuples(index=False), items.itertuples(index=False))
    assert any(row[2] for row in wanted)
    assert rows(QUERIES["op5_benchmark_decontamination"](spark, SMALL)) == wanted


@pytest.mark.parametrize("seed,gram", [(1, 5), (2, 2), (3, 13)])
def test_against_brute_force(spark, seed, gram):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "c1", "é", "É", "dd"]
    text = lambda n: "".join(draw.choice(vocabulary) + draw.choice([" ", "-", "\n", ". "]) for _ in range(n))
    items = [(i % 7 if i % 5 else None, text(draw.choice([0, 1, 3, 12, 13, 14, 40]))) for i in range(20)]
    docs = [(i, text(draw.randint(0, 90))) for i in range(30)] + [(40, None), (41, items[3][1] + " " + items[7][1])]
    found = decontaminate.measure(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), gram=gram,
    )
    assert rows(found) == brute(docs, items)


def test_shuffled_marks_give_the_same(spark, small, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    wanted = brute(small.itertuples(index=False), items.itertuples(index=False))
    assert rows(QUERIES["op5_benchmark_decontamination"](spark, SMALL)) == wanted


def test_long_documents_with_shuffled_marks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    docs = [(1, " ".join(f"w{i}" for i in range(3000))), (2, "x y"), (3, " ".join(f"w{i}" for i in range(3000)))]
    items = [(1, " ".join(f"w{i}" for i in range(100, 160))), (2, "x y")]
    found = decontaminate.measure(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert rows(found) == brute(docs, items)


def test_odd_documents(spark, odd_docs):
    items = spark.createDataFrame(
        [(1, "three FOUR"), (2, None), (3, ""), (None, "mot mot"), (1, "three FOUR")], "item_id long, text string"
    )
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows(decontaminate.measure(odd_docs, items)) == brute(docs, [(1, "three FOUR"), (None, "mot mot")])
    clean = decontaminate.clean(odd_docs, items)
    assert clean.columns == odd_docs.columns
    bad = [r for r in brute(docs, [(1, "three FOUR"), (None, "mot mot")]) if r[5]]
    assert clean.count() == len(docs) - len(bad)
    assert decontaminate.clean(odd_docs, items.limit(0)).count() == len(docs)
    assert decontaminate.measure(odd_docs.limit(0), items).count() == 0


def test_repetitive_texts_are_linear(spark):
    """Texts and items of one word many times over: no product of places."""
    docs = [(1, "one " * 100_000), (2, "one two " * 50_000), (3, "two " * 12), (4, "one " * 13 + "three " * 400)]
    items = [(1, "one " * 100_000), (2, "two one " * 3_000), (3, "one " * 14)]
    found = decontaminate.measure(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found] == [
        (100_000, 100_000, 2, True), (100_000, 100_000, 1, True), (12, 0, 0, False), (413, 13, 2, False)
    ]


def test_no_first_words_of_short_items_are_missed(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "FIRST_WORDS", 1)
    docs = [(1, "a b c"), (2, "b c"), (3, "c a b"), (4, "x")]
    items = [(1, "a b"), (2, "c"), (3, "y z")]
    found = decontaminate.measure(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert rows(found) == brute(docs, items)


def test_no_python_on_the_way(spark):
    plan = QUERIES["op5_benchmark_decontamination"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
