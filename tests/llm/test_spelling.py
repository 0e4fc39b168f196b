import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from paperlake.llm import spelling
from paperlake.llm.queries import QUERIES

from .conftest import SMALL


def edits(word, alphabet):
    for i in range(len(word) + 1):
        if i < len(word):
            yield word[:i] + word[i + 1 :]
        for c in alphabet:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            total[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    known = counted(rows)
    alphabet = sorted({c for w in known for c in w})
    form = {}
    near = {w: {x for x in edits(w, alphabet) if x in known and x != w} for w in known}
    for w in known:
        best = min(near[w], key=lambda x: (-known[x], x), default=None)
        form[w] = best if best is not None and known[best] >= 2 * known[w] else None
    out = []
    for w in known:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, known[w], len(near[w]), known[form[w]] if form[w] else None))
    return sorted(out)


def test_production_query(spark, small):
    found = sorted(map(tuple, QUERIES["op13_spelling_variants"](spark, SMALL).collect()))
    expected = brute([(int(i), t) for i, t in zip(small["doc_id"], small["text"])])
    assert found == expected and sum(row[1] is not None for row in found) > 20


@pytest.mark.parametrize("seed,frequent,list_words", [(1, 50, 8192), (2, 3, 8192), (3, 1, 20)])
def test_against_brute_force(spark, seed, frequent, list_words):
    """Small alphabets and one common stem, so that lists are long and are cut into blocks."""
    draw = np.random.default_rng(seed)
    letters = list("abcé")
    stems = ["".join(draw.choice(letters, int(draw.integers(5, 9)))) for _ in range(60)] + ["gemeinsamkeit"] * 40
    rows = []
    for i in range(300):
        word = stems[int(draw.integers(0, len(stems)))]
        at = int(draw.integers(0, len(word) + 1))
        kind = int(draw.integers(0, 4))
        changed = [word, word[:at] + "a" + word[at:], word[:at] + word[at + 1 :], word[:at] + "b" + word[at + 1 :]][kind]
        rows.append((i, " ".join([changed.upper() if i % 5 == 0 else changed] * int(draw.integers(3, 30)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = spelling.variants(spelling.words(docs).cache(), frequent=frequent, list_words=list_words).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_odd_rows(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE_BYTES", 30)
    docs = odd_docs.collect()
    found = spelling.measure(odd_docs).collect()
    assert sorted(map(tuple, found)) == brute([(r.doc_id, r.text) for r in docs])
    assert spelling.measure(odd_docs.limit(0)).collect() == []
    long, other = "x" * 70_000, "é" * 60
    rows = [
        (1, f"{long} {long}y {long[1:]} " * 3), (2, f"{other}, {other}a, b{other[1:]}, " * 4), (3, "ÀÈ×÷ÿß " * 3 + "Àè×÷ÿß " * 9),
        (4, "日本words語words日words"), (5, "àbcdef " * 3), (6, "naïveté NAÏVETÉ naÏvetÉ " * 5),
    ]
    found = spelling.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # The alphabet-wide brute force is too slow for words of 70,000 letters: compare all pairs.
    known = counted(rows)
    near = {w: [x for x in known if spelling.one_edit(w, x)] for w in known}
    assert {r.word: (r.n, r.n_near) for r in found} == {w: (n, len(near[w])) for w, n in known.items()}


def test_forms_lead_to_a_root(spark):
    """A chain of nine words, each twice as frequent as the one before, and one hot root."""
    chain = ["aaaaa" + "b" * i for i in range(9)]
    rows = [(w, 3 * 2**i) for i, w in enumerate(chain)] + [(f"{chain[-1][:4]}{c}{chain[-1][5:]}", 3) for c in "cdefgh"]
    found = spelling.variants(spark.createDataFrame(rows, "word string, n long"))
    assert {r.root for r in found.collect()} == {chain[-1]}


def test_one_edit_and_bounds():
    draw = np.random.default_rng(5)
    pool = ["".join(draw.choice(list("ab"), int(draw.integers(5, 8)))) for _ in range(400)]
    by_gram = defaultdict(int)
    for word in set(pool):
        for place in range(len(word) + 1):
            for size in (2, 3, 4):
                by_gram[f"\x02{word}\x03"[place : place + size]] += 1
    frequent = {g: n for g, n in by_gram.items() if n > 4}
    for a in set(pool):
        own = spelling.grams(a, frequent)
        least = len(own) - spelling.affected(own)
        assert least > 0
        for b in set(pool):
            near = a != b and b in set(edits(a, "ab"))
            assert spelling.one_edit(a, b) == near
            if near:
                common = Counter(g for _, g in own) & Counter(g for _, g in spelling.grams(b, frequent))
                assert sum(common.values()) >= least
