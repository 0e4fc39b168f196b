import hashlib

import numpy as np
import pytest

from paperlake.llm import suffixes
from paperlake.llm.hashing import Substrings
from paperlake.llm.queries import QUERIES

from .conftest import SMALL, invented


def brute(texts: list[bytes], length: int) -> list[tuple]:
    seen: dict[bytes, int] = {}
    for text in texts:
        for p in range(len(text) - length + 1):
            seen[text[p : p + length]] = seen.get(text[p : p + length], 0) + 1
    out = []
    for text in texts:
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            if seen[text[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def found(rows) -> list[tuple]:
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


@pytest.mark.parametrize("seed,length", [(1, 400), (2, 300), (3, 257)])
def test_against_brute_force(spark, seed, length):
    texts = invented(seed) + [(900, "ab" * 700), (901, "x" * length), (902, "x" * (length - 1)), (903, "é" * length)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = suffixes.measure(docs, length=length).orderBy("doc_id").collect()
    assert found(rows) == brute([t.encode() for _, t in texts], length)


def test_production_query(spark, small):
    rows = QUERIES["op2_suffix_array_dedup"](spark, SMALL).orderBy("doc_id").collect()
    texts = [t.encode() for _, t in sorted(small.itertuples(index=False))]
    assert found(rows) == brute(texts, 400)


def test_texts_of_two_letters(spark):
    """Thue-Morse texts and their opposites, whose sums by single bytes are equal though they differ."""
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [(1, "x" * 50 + one[:1024]), (2, other[:1024] + "y" * 50), (3, one[512:1536] + "z"), (4, other[100:600])]
    rows = suffixes.measure(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert found(rows) == brute([t.encode() for _, t in texts], 400)
    data = np.frombuffer((one[:1024] + other[:1024]).encode(), np.uint8)
    starts, ends = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(Substrings(data).of(starts, ends).tolist())) == 1
    assert len(set(Substrings(data, by_word=True).of(starts, ends).tolist())) == 2


def test_buckets_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_SUFFIXES", 60)
    texts = invented(9, 40)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = suffixes.measure(docs, length=300).orderBy("doc_id").collect()
    assert found(rows) == brute([t.encode() for _, t in texts], 300)
    assert all(r.repeated == (r.n_removed > 0) for r in rows)


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT_BYTES", 700)
    texts = invented(5, 30)
    docs = [t.encode() for _, t in texts]
    parts = [p for _, p in suffixes._segments(docs[-1] * 3, 400)]
    assert all(len(p) <= 700 + 399 for p in parts)
    starts = {at + i for at, p in suffixes._segments(docs[-1] * 3, 400) for i in range(len(p) - 399)}
    assert starts == set(range(max(0, len(docs[-1]) * 3 - 399)))


def test_equal_strings_have_equal_anchors():
    text = invented(7)[3][1].encode() + b" " + invented(8)[2][1].encode()
    text = (text + b" tail") * 2
    half = len(text) // 2
    number, first, width, head, _ = suffixes.runs([text], 400, 128)
    of = {}
    for a, w, k in zip(first.tolist(), width.tolist(), head.tolist()):
        for p in range(a, a + w):
            of[p] = k
    assert all(of[p] == of[p + half] for p in range(half - 400))


def test_multikey_order():
    draw = np.random.default_rng(1)
    columns = [draw.integers(0, 5, 2000) for _ in range(4)]
    order = suffixes.multikey_order(columns)
    assert (np.stack(columns)[:, order] == np.stack(columns)[:, np.lexsort(columns[::-1])]).all()


def test_odd_documents(spark, odd_docs):
    rows = suffixes.removed(odd_docs, column="cut").collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r["cut"] for r in rows if r.doc_id is not None}
    assert by[2].n_bytes == 0 and by[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[6].n_bytes == 160_000 and by[6].n_removed == 160_000 and by[1].n_removed == 0
    assert suffixes.measure(odd_docs.limit(0)).count() == 0
