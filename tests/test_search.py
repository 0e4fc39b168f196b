import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.operators import ann
from paperlake.operators import search as sr

from .conftest import plan_of

K = 4


def brute_force(papers, questions, k=K, topics=False):
    """Neighbours by plain loops: {qid: [(id, distance), ...]}."""
    found = {}
    for qid, q, topic in questions:
        rows = []
        for id_, p, paper_topic in papers:
            if p is None or len(p) != len(q) or any(x is None for x in p) or not any(p):
                continue
            if topics and topic is not None and paper_topic != topic:
                continue
            p, r = np.array(p, np.float32).astype(float), np.array(q, np.float32).astype(float)
            rows.append((round(1 - p @ r / np.sqrt((p @ p) * (r @ r)), 12), id_))
        found[qid] = [(i, d) for d, i in sorted(rows)[:k]]
    return found


def collected(hits):
    found = {}
    for r in sorted(hits.collect(), key=lambda r: (r["qid"], r["rk"])):
        found.setdefault(r["qid"], []).append((r["arxiv_id"], r["distance"]))
    return found


def same(got, want):
    want = {q: rows for q, rows in want.items() if rows}
    assert set(got) == set(want)
    for qid, rows in want.items():
        assert [i for i, _ in got[qid]] == [i for i, _ in rows]
        assert [d for _, d in got[qid]] == pytest.approx([d for _, d in rows], abs=1e-9)


@pytest.fixture(scope="module")
def rows():
    """A third of the papers are copies of one vector, some have none or a bad one."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    papers = []
    for i in range(400):
        v = (centers[i % 6] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()
        if i % 3 == 0:
            v = centers[0].astype(np.float32).tolist()
        papers.append((f"p{i:04d}", v, i % 4))
    papers += [("none", None, 1), ("short", [1.0] * 7, 1), ("hole", [1.0] * 7 + [None], 1),
               ("zero", [0.0] * 8, 1)]
    questions = [
        (i, (centers[i % 6] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist(),
         [None, 0, 1, 2, 99][i % 5])
        for i in range(45)
    ]
    questions.append((45, papers[0][1], None))  # equal to the copies: a wide tie
    return papers, questions


@pytest.fixture(scope="module")
def frames(spark, rows):
    papers = spark.createDataFrame(rows[0], "arxiv_id string, embedding array<float>, topic_id long")
    questions = spark.createDataFrame(rows[1], "qid long, vector array<float>, topic_id long")
    return papers.repartition(5), questions


@pytest.mark.parametrize("topics", [False, True])
@pytest.mark.parametrize("way", ["scan", "cells"])
def test_knn_join_is_exact(rows, frames, monkeypatch, topics, way):
    if way == "cells":
        monkeypatch.setattr(sr, "QUESTION_BYTES", 0)
        monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
        monkeypatch.setattr(ann, "QUESTION_ROWS", 7)
    papers, questions = frames
    centroids = ann.train_cells(papers, 5, dim=8) if way == "cells" else None
    hits = sr.knn_join(questions, papers, K, "topic_id" if topics else None, centroids)
    same(collected(hits), brute_force(*rows, topics=topics))
    ranks = hits.groupBy("qid").agg(F.sort_array(F.collect_list("rk")).alias("rk")).collect()
    assert all(r["rk"] == list(range(1, len(r["rk"]) + 1)) for r in ranks)


@pytest.mark.parametrize("way", ["scan", "cells"])
def test_each_question_has_its_own_k(rows, frames, monkeypatch, way):
    papers, questions = frames
    if way == "cells":
        monkeypatch.setattr(sr, "QUESTION_BYTES", 0)
        monkeypatch.setattr(ann, "BLOCK_ROWS", 90)
    centroids = ann.train_cells(papers, 4, dim=8) if way == "cells" else None
    wanted = questions.withColumn("top_k", (F.col("qid") % 6).cast("int"))
    got = collected(sr.knn_join(wanted, papers, "top_k", centroids=centroids))
    full = brute_force(*rows, k=6)
    same(got, {q: hits[: q % 6] for q, hits in full.items()})


@pytest.mark.parametrize("topics", [False, True])
def test_a_first_look_bounds_what_tasks_emit(rows, frames, monkeypatch, topics):
    """Sixty-four tasks, of which eight are looked at first: same hits, a fraction of the rows."""
    papers, questions = frames
    monkeypatch.setattr(sr, "BOUND_STRIDE", 8)
    dealt = papers.repartition(64).select("arxiv_id", "embedding", F.col("topic_id").alias("topic"))
    asked = sr.asked_of(questions, K, "topic_id" if topics else None)
    free, bounded = (sr._scan_join(asked, dealt, 8, way) for way in (False, True))
    same(collected(sr.rank_hits(bounded, K)), brute_force(*rows, topics=topics))
    emitted = free.count(), bounded.count()
    assert emitted[1] < emitted[0] / (2 if topics else 3), emitted
    monkeypatch.setattr(sr, "BOUND_HITS", 0)
    same(collected(sr.knn_join(questions, papers, K, "topic_id" if topics else None)), brute_force(*rows, topics=topics))


def test_approximate_with_all_cells_is_exact(rows, frames, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    papers, questions = frames
    centroids = ann.train_cells(papers, 6, dim=8)
    placed = ann.assign_cells(papers, centroids)
    all_cells = ann.ann_join(questions, placed, centroids, K, 6)
    same(collected(all_cells), brute_force(*rows))
    exact = sr.knn_join(questions, papers, K)
    assert ann.recall_at_k(all_cells, exact).first()["recall"] == 1.0
    fewer = ann.ann_join(questions, placed, centroids, K, 1)
    assert 0 < ann.recall_at_k(fewer, exact).first()["recall"] <= 1.0


def test_unusable_vectors_have_no_cell(spark, frames):
    centroids = spark.createDataFrame([(3, [1.0] * 8), (1, [-1.0] * 8)], "cell int, centroid array<double>")
    placed = {r["arxiv_id"]: r["cell"] for r in ann.assign_cells(frames[0], centroids).collect()}
    assert all(placed[i] is None for i in ("none", "short", "hole", "zero"))
    assert {c for i, c in placed.items() if i.startswith("p")} <= {1, 3}


def test_stored_cells_are_pruned(spark, frames, tmp_path):
    papers, questions = frames
    centroids = ann.train_cells(papers, 6, dim=8)
    stored = ann.write_cells(papers, centroids, str(tmp_path / "cells"))
    assert stored.count() == 400
    found = ann.ann_join(questions.limit(1), stored, centroids, K, 2)
    filters = re.findall(r"PartitionFilters: \[(.*?)\]", plan_of(found))
    assert any("cell#" in f and " IN " in f for f in filters)


def test_search_one_vector(rows, frames):
    papers, questions = rows
    vector = questions[3][1]
    want = brute_force(papers, [(0, vector, None)], 10)[0]
    found = sr.search(frames[0], vector, 10).collect()
    assert [r["arxiv_id"] for r in found] == [i for i, _ in want]
    want = brute_force(papers, [(0, vector, 0)], 10, topics=True)[0]
    found = sr.search(frames[0], vector, 10, topic_id=0).collect()
    assert [r["arxiv_id"] for r in found] == [i for i, _ in want]
    assert sr.search(frames[0], vector, 10, topic_id=99).count() == 0


def test_a_zero_vector_cannot_be_searched(frames):
    with pytest.raises(ValueError):
        sr.search(frames[0], [0.0] * 8, 3)


def test_no_questions(spark, frames):
    none = spark.createDataFrame([], "qid long, vector array<float>")
    assert sr.knn_join(none, frames[0], 3).count() == 0


def test_plans(frames):
    papers, questions = frames
    one = plan_of(sr.search(papers, [1.0] * 8, 3))
    assert "TakeOrderedAndProject" in one
    many = plan_of(sr.knn_join(questions, papers, 3))
    assert "MapInArrow" in many and "WindowGroupLimit" in many
    for plan in (one, many):
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _both_ways(spark, questions, papers, monkeypatch, **options):
    """knn_join by the scan, and routed to cells."""
    scan = sorted(map(tuple, sr.knn_join(questions, papers, 3, **options).collect()))
    monkeypatch.setattr(sr, "QUESTION_BYTES", -1)
    routed = sorted(map(tuple, sr.knn_join(questions, papers, 3, **options).collect()))
    monkeypatch.undo()
    return scan, routed


def test_both_ways_agree_on_odd_vectors(spark, monkeypatch):
    big = 2**53 + 1
    papers = spark.createDataFrame(
        [("a", [1e-50, 0.0], big), ("b", [1.0, 1e-7], big), ("c", [0.0, 1.0], big - 1), ("d", [1.0, 0.5], big)],
        "arxiv_id string, embedding array<double>, topic_id long",
    )
    questions = spark.createDataFrame(
        [("x", [1.0, 2.0, 3.0], None), ("q", [1.0, 0.0], None), ("q", [0.0, 1.0], None), ("t", [0.0, 1.0], big)],
        "qid string, vector array<double>, topic_id long",
    )
    centroids = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.1, 1.0])], "cell int, centroid array<double>")
    scan, routed = _both_ways(spark, questions, papers, monkeypatch, topic_col="topic_id", centroids=centroids)
    assert scan == routed
    assert [r[1] for r in sorted(scan, key=lambda r: r[3]) if r[0] == "t"] == ["d", "b", "a"]
    assert sum(r[0] == "q" for r in scan) == 6 and not any(r[0] == "x" for r in scan)
    assert {r[1] for r in scan if r[0] == "q" and r[3] == 1} == {"a", "c"}
    assert all(r[1] != "c" for r in scan if r[0] == "t")


def test_topics_are_searched_without_cells(rows, frames, monkeypatch):
    """Questions with a topic meet the papers of some topics; no cells are made of all papers."""
    def no_cells(*_, **__):
        raise AssertionError("cells are trained")

    papers, questions = frames
    monkeypatch.setattr(ann, "train_cells", no_cells)
    monkeypatch.setattr(sr, "QUESTION_BYTES", 0)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    asked = questions.where("topic_id IS NOT NULL")
    want = brute_force(rows[0], [q for q in rows[1] if q[2] is not None], topics=True)
    same(collected(sr.knn_join(asked, papers, K, "topic_id")), want)


def test_a_question_is_copied_by_regions_not_by_cells(rows, frames, monkeypatch):
    """Forty cells in two regions: a question is sent to its cell, then to two regions at most."""
    sent, routed_join = [], ann.routed_join

    def counted(routed, *more):
        sent.append(routed.count())
        return routed_join(routed, *more)

    papers, questions = frames
    monkeypatch.setattr(ann, "BLOCK_ROWS", 250)
    centroids = ann.cut(ann.train_cells(papers, 40, dim=8))
    monkeypatch.setattr(ann, "routed_join", counted)
    asked = questions.select("qid", "vector", F.lit(None).cast("long").alias("topic"), F.lit(200).alias("k"))
    known = papers.select("arxiv_id", "embedding", F.lit(None).cast("long").alias("topic"))
    same(collected(ann.exact_join(asked, known, 8, centroids)), brute_force(*rows, k=200))
    assert sent[0] == len(rows[1]) and sent[1] <= 2 * len(rows[1])
