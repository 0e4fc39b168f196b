import hashlib
import re

import numpy as np
import pytest

from paperlake.llm import infill
from paperlake.llm.queries import QUERIES

from .conftest import SMALL


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    elif h[3] % 100 < 20:
        form, out, sizes = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", (len(prefix), len(middle))
    else:
        form, out, sizes = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", (len(prefix), len(middle))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *sizes, sha(out), sha(text))


def key(row):
    return tuple((x is None, x) for x in row)


def test_production_query(spark, small):
    found = sorted(map(tuple, QUERIES["op11_fill_in_middle"](spark, SMALL).collect()))
    assert found == sorted(brute(int(i), t) for i, t in zip(small["doc_id"], small["text"]))
    assert {row[2] for row in found} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(infill, "SLICE_BYTES", 40)
    found = infill.measure(odd_docs).collect()
    expected = [brute(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    whole = infill.infilled(odd_docs, column="made")
    assert whole.columns == [*odd_docs.columns, "made"]
    assert infill.measure(odd_docs.limit(0)).count() == 0
    assert infill.infilled(odd_docs.limit(0)).columns[-1] == "infill"


@pytest.mark.parametrize("seed", range(3))
def test_texts_of_all_characters(spark, seed):
    draw = np.random.default_rng(seed)
    signs = ["a", "Bc", "xyz", "é", "ß", "☃", "漢", "😀", "́", "<", ">", "<P", "S>", "M", " ", "\n", "\x00", "1", "½"]
    rows = [(i, "".join(draw.choice(signs, int(draw.integers(0, 40))))) for i in range(300)]
    rows += [(1000 + i, "a" * i + mark) for i in range(20) for mark in ("", "<P>", "<M>")]
    rows += [(5000, "é😀x" * 300_000), (5001, "z" * 1_000_000), (5002, "<S" * 1000)]
    found = infill.measure(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(brute(*row) for row in rows)


def test_exception_index():
    text = "aé☃bb😀c" * 5
    data = np.frombuffer(text.encode(), np.uint8)
    index = infill.Exceptions(data)
    chars = np.arange(len(text) + 1)
    byte = np.array([len(text[:i].encode()) for i in chars])
    assert (index.chars(byte) == chars).all() and (index.bytes(chars) == byte).all()
    assert len(index.byte) == sum(c > "\x7f" for c in text)
