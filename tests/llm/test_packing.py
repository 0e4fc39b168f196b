import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from paperlake.llm import packing
from paperlake.llm.queries import QUERIES, tokenizer_path

from ..conftest import plan_of
from .conftest import SMALL

PATH = tokenizer_path("word_bpe_49k.json")


def plain_best_fit(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    opened = 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, opened = capacity, opened + 1
        if room > length:
            bisect.insort(rooms, room - length)
    return opened


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 37, 128])
    lengths = [draw.randint(1, draw.choice([capacity, capacity // 2, 4])) for _ in range(draw.randint(1, 400))]
    plan = packing.best_fit_plan(Counter(lengths), capacity)
    fill: dict[int, list] = {}
    for length, n in Counter(lengths).items():
        runs = plan[length]
        for number in range(n):
            first, sequence, each, offset = runs[np.searchsorted(runs[:, 0], number, side="right") - 1]
            along = number - first
            fill.setdefault(sequence + along // each, []).append((offset + along % each * length, length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(fill) == plain_best_fit(lengths, capacity)


def test_capacities_against_a_scan():
    draw = random.Random(1)
    tree, used = packing.Capacities(50), set()
    for _ in range(2000):
        c = draw.randint(0, 50)
        (used.add if draw.random() < 0.5 else used.discard)(c)
        tree.set(c, c in used)
        x = draw.randint(0, 50)
        assert tree.least(x) == min((u for u in used if u >= x), default=None)


ODD = [
    "<|ENDOFTEXT|> x <|endoftext|>", "Don'T A.B, c,, ..., x.", "ÉÀ, Ÿ. ÿ,", ".", "don't we'll 'S x's", "İstanbul ΣΑΣ ς",
    "é café́", "a² ªº ½ 12 3a", "--- \"(x)\" |", "x\x1cy \x85 z", "　日本語 テスト", "ß!!! Straße,", "a" * 300 + " é" * 90,
    "\x0b\x0c a", "¨ ̈a ̈", "word*** a%%% x_y z_ $$$ #& {a} [b]] `c` ~d~ <e> a<b f<> g|h + i+= j/\\ k^@ été*=_", "aaaa aaaaaaaa abababab", "", "   ", "µ\nµ",
]


def test_ids_are_the_tokenizers(small):
    whole, mine = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    texts = ODD + small["text"].tolist()
    for text, ids in zip(texts, map(mine, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


def test_ids_beyond_the_kept_words(small, monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 50)
    monkeypatch.setattr(packing, "SIGNED_KEPT", 20)
    whole, mine = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for text in small["text"].tolist()[:20]:
        assert np.frombuffer(mine(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_are_kept_without_single_signs():
    whole, mine = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    texts = ["Onherth, tionwh. onherth; 3.14, don't, x's. Été! été?", "Onherth) tionwh: (tionwh) a.b,c", "onherth., tionwh!?", "«été», ¿qué? été.",
             "2×3. été×.", "'s, 't. ,'s x.'s", "a. 's b, 't", "ª, ²."]
    for text in texts:
        assert np.frombuffer(mine(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert {"onherth", "tionwh", "été"} <= set(mine.runs) and not {"onherth,", "onherth;", "tionwh.", "été!"} & set(mine.runs)


def checked(rows, texts: dict, capacity: int) -> int:
    whole = Tokenizer.from_file(PATH)
    for doc_id, group in rows.groupby("doc_id"):
        ids = np.array(whole.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        group = group.sort_values("piece")
        assert group.piece.tolist() == list(range(-(-len(ids) // capacity)))
        for piece, start, length, crc in group[["piece", "start", "length", "ids_crc32"]].itertuples(index=False):
            assert start == piece * capacity and length == min(capacity, len(ids) - start)
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
    for _, group in rows.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group.length.cumsum() - group.length == group.offset).all() and group.length.sum() <= capacity
    return rows.sequence_id.nunique()


def test_production_query(spark, small):
    rows = QUERIES["op4_best_fit_packing"](spark, SMALL).toPandas()
    assert set(rows.doc_id) == set(small.doc_id)
    assert checked(rows, dict(small.itertuples(index=False)), 2048) == plain_best_fit(rows.length.tolist(), 2048)


def test_texts_are_tokenised_once(spark, odd_docs):
    assert plan_of(packing.pieces(odd_docs, PATH, 64)).count("ArrowEvalPython [") == 1


def test_odd_documents(spark, odd_docs):
    rows = packing.pack(odd_docs.where("doc_id <> 1"), PATH, 64).toPandas()
    texts = {r.doc_id: r.text for r in odd_docs.where("doc_id <> 1").collect()}
    checked(rows, texts, 64)
    every = packing.pack(odd_docs, PATH, 64)
    assert every.where("piece = 0").count() == odd_docs.count()
    assert packing.pack(odd_docs.limit(0), PATH).count() == 0


def test_words_that_occur_once_take_little_room():
    encode = packing.Encoder(PATH)
    words = ["".join(chr(97 + n // 26**i % 26) for i in range(4)) for n in range(160_000)]
    ids = encode(" ".join(words))
    assert len(encode.runs) < 100_000
    assert encode(" ".join(words[::-1][:50])) == encode.runs.whole(" ".join(words[::-1][:50])) and len(ids) >= 4 * len(words)
