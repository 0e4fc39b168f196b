import re

import pytest

from paperlake.llm import jaccard
from paperlake.llm.components import components
from paperlake.llm.queries import QUERIES

from ..conftest import plan_of
from .conftest import SMALL, invented

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    own = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))) if own else frozenset()


def brute(docs, words, percent):
    sets = [(i, shingle_set(t, words)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, len(a), least[find(x)]) for x, (i, a) in enumerate(sets))


@pytest.mark.parametrize("seed,words,percent,group", [(1, 4, 85, 256), (2, 2, 40, 2), (3, 5, 80, 3), (4, 1, 30, 1)])
def test_against_brute_force(spark, monkeypatch, seed, words, percent, group):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", group)
    monkeypatch.setattr(jaccard, "QUERY_ROWS", group)
    docs = invented(seed, 80) + [(500, "Same  words\there"), (501, "same words here"), (502, "")]
    rows = jaccard.joined(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(6), words=words, percent=percent
    ).collect()
    assert sorted(map(tuple, rows)) == brute(docs, words, percent)
    assert len({r.component_id for r in rows}) < len(rows) - 5


def test_shuffled_ids_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    docs = invented(9, 50)
    rows = jaccard.joined(spark.createDataFrame(docs, "doc_id long, text string"), words=4, percent=85).collect()
    assert sorted(map(tuple, rows)) == brute(docs, 4, 85)


def test_production_query(spark, small):
    rows = QUERIES["op8_ngram_jaccard_join"](spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == brute(list(small.itertuples(index=False)), 4, 85)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(300, 300), (210, 205), (205, 210)]
    found = components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    roots = {r.node: r.root for r in found}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[i] == 100 for i in range(100, 130))
    assert roots[205] == roots[210] == 205 and 300 not in roots and len(found) == len(roots)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark, odd_docs):
    rows = jaccard.joined(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 7)} == {1}
    by = {r.doc_id: r for r in rows}
    assert by[2].n_shingles == 0 and by[2].component_id == 2 and by[6].n_shingles == 1
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([
        (1, "one two three four five six"), (2, ""), (3, ""), (0, "lost id with a few words here"), (0, ""),
        (5, "…  12 34"), (6, "mot " * 40_000),
    ])
    assert jaccard.joined(odd_docs.limit(0)).count() == 0 and jaccard.one_of_each(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("repeats", [False, True])
def test_kept_rows_are_found_without_python(spark, monkeypatch, repeats):
    docs = [(i, t) for i, t in invented(11, 60)] + [(700, None), (701, " \t\x0b"), (702, "\u00a0"), (703, "two words")]
    docs += [(703, "Two  words"), (703, "two words"), (701, "")] * repeats
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    kept = jaccard.one_of_each(table)
    plan = plan_of(kept)
    assert not any(word in plan for word in ("Python", "Pandas", "InArrow"))
    assert ("Window" in plan) == repeats and "BroadcastHashJoin" in plan
    least = {component for _, _, component in brute([(i, t or "") for i, t in docs if i < 700], 5, 80)}
    wanted = [(i, t) for i, t in docs if i in least or i in (700, 701, 702)] + [(703, "Two  words" if repeats else "two words")]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, wanted))
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    assert sorted(map(repr, map(tuple, jaccard.one_of_each(table).collect()))) == sorted(map(repr, wanted))
