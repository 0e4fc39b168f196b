import hashlib
import random
import zlib

import pytest

from paperlake.llm import sharding
from paperlake.llm.queries import QUERIES

from .conftest import SMALL, invented


def optimum(docs, shards):
    sizes = {}
    for _, text in docs:
        key = "" if text is None else hashlib.md5(text.encode()).hexdigest()
        sizes[key] = sizes.get(key, 0) + len((text or "").encode()) + 1
    ordered = [sizes[k] for k in sorted(sizes)]
    best = [0] + [10**18] * len(ordered)
    for _ in range(shards):
        now = [0] + [10**18] * len(ordered)
        for end in range(1, len(ordered) + 1):
            total = 0
            for start in range(end - 1, -1, -1):
                total += ordered[start]
                now[end] = min(now[end], max(best[start], total))
        best = [min(a, b) for a, b in zip(best, now)]
    return best[-1]


def checked(rows, docs, shards):
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    text = dict(docs)
    by, home = {}, {}
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert 0 <= r.shard < shards and home.setdefault(text[r.doc_id], r.shard) == r.shard
        by.setdefault(r.shard, []).append(r)
    for group in by.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    return max(sum(r["size"] for r in group) for group in by.values())


@pytest.mark.parametrize("seed,shards,digits", [(1, 16, 3), (2, 5, 1), (3, 3, 1), (4, 40, 1)])
def test_least_largest_shard(spark, monkeypatch, seed, shards, digits):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", digits)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    draw = random.Random(seed)
    docs = invented(seed, 50) + [(200 + i, "same text " * draw.randint(1, 9)) for i in range(30)] + [(400, None), (401, "")]
    rows = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shards).collect()
    assert checked(rows, docs, shards) == optimum(docs, shards)


def test_one_group_with_a_third_of_all(spark):
    docs = [(i, "hot " * 50) for i in range(60)] + [(100 + i, f"text {i} " * 12) for i in range(120)]
    rows = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert checked(rows, docs, 16) == optimum(docs, 16)


@pytest.mark.parametrize("part", [3, 20])
def test_few_rows_to_the_driver_with_a_large_group(spark, monkeypatch, part):
    """``part``: the group's share of all bytes, as a divisor."""
    n = 60_000
    groups = spark.range(n).selectExpr(
        "md5(cast(id AS string)) AS key", f"CASE WHEN id = 5 THEN {n * 100 // (part - 1)} ELSE 50 + id % 101 END AS size"
    )
    taken, units = [], sharding._units
    monkeypatch.setattr(sharding, "_units", lambda *of: [taken.append(len(found := units(*of))), found][1])
    cuts = sharding.minimax_cuts(groups, 16)
    assert max(taken) <= 12_000 and sum(taken) <= 16_000
    rows = sorted(map(tuple, groups.collect()))

    def filled(capacity):
        starts, held = [], 0
        for key, size in rows:
            if held + size > capacity:
                starts.append(key)
                held = 0
            held += size
        return starts

    low, high = max(size for _, size in rows), sum(size for _, size in rows)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if len(filled(middle)) < 16 else (middle + 1, high)
    assert cuts == filled(low)


def test_production_query(spark, small):
    docs = list(small.itertuples(index=False, name=None))
    rows = QUERIES["op9_sharding"](spark, SMALL).collect()
    assert checked(rows, docs, 16) == optimum(docs, 16)


def test_odd_documents(spark, odd_docs):
    rows = sharding.assign(odd_docs).collect()
    assert len(rows) == odd_docs.count() and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 2} == {(1, 0)}
    assert sharding.assign(odd_docs.limit(0)).count() == 0
    plan = QUERIES["op9_sharding"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
