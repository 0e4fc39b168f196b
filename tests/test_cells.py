"""Cells in two levels, and an index of papers that lives through appends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.operators import ann
from paperlake.operators.cell_index import CellIndex

from .test_search import K, brute_force, collected, frames, rows, same  # noqa: F401  (fixtures)


def asked_of(questions, k=K):
    return questions.select("qid", "vector", F.lit(None).cast("long").alias("topic"), F.lit(k).alias("k"))


def known_of(papers):
    return papers.select("arxiv_id", "embedding", F.lit(None).cast("long").alias("topic"), "cell", "angle")


def test_cells_in_two_levels(rows, frames, monkeypatch):  # noqa: F811
    """The number of cells follows the papers; both levels are used; the join by them is exact."""
    papers, questions = frames
    monkeypatch.setattr(ann, "CELL_PAPERS", 16)
    monkeypatch.setattr(ann, "FLAT_CELLS", 8)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    centroids = ann.cut(ann.train_cells(papers, dim=8))
    found = centroids.collect()
    assert 10 <= len(found) <= 40 and len({r["branch"] for r in found}) == 5
    assert sorted(r["cell"] for r in found) == list(range(len(found)))
    placed = ann.assign_cells(papers, centroids).where("cell IS NOT NULL").collect()
    branch = {r["cell"]: r["branch"] for r in found}
    tops = {r["branch"]: np.array(r["branch_centroid"]) for r in found}
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    for r in placed:
        v = np.array(r["embedding"])
        best = max(tops, key=lambda b: cos(v, tops[b]))
        assert cos(v, tops[branch[r["cell"]]]) == pytest.approx(cos(v, tops[best]))
        own = {c["cell"]: cos(v, np.array(c["centroid"])) for c in found if c["branch"] == branch[r["cell"]]}
        assert own[r["cell"]] == pytest.approx(max(own.values()))
    hits = ann.exact_join(asked_of(questions), papers.select("arxiv_id", "embedding", F.lit(None).cast("long").alias("topic")), 8, centroids)
    same(collected(hits), brute_force(*rows))


def test_few_cells_for_few_papers(frames):  # noqa: F811
    assert ann.train_cells(frames[0], dim=8).count() == 2


def test_too_many_centroids_are_refused_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(ann, "CENTROID_BYTES", 100)
    centroids = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "cell int, centroid array<double>")
    with pytest.raises(ValueError, match="more than 6"):
        ann.Centroids(centroids)


@pytest.mark.parametrize("flat", [1024, 4])
def test_an_index_lives_through_appends(rows, frames, tmp_path, monkeypatch, flat):  # noqa: F811
    """Written in two appends and split; searched as it is stored."""
    papers, questions = frames
    monkeypatch.setattr(ann, "FLAT_CELLS", flat)
    centroids = ann.train_cells(papers, 6, dim=8)
    half = F.pmod(F.xxhash64("arxiv_id"), F.lit(2)) == 0
    index = CellIndex.create(papers.where(half), str(tmp_path / "index"), centroids)
    index.append(papers.where(~half))
    assert index.papers().count() == 400
    before = {r["arxiv_id"]: r["cell"] for r in index.papers().collect()}

    def no_assignment(*_):
        raise AssertionError("papers are assigned again")

    def check():
        with monkeypatch.context() as patch:
            patch.setattr(ann, "assign_cells", no_assignment)
            hits = ann.exact_join(asked_of(questions), known_of(index.papers()), 8, index.centroids())
            same(collected(hits), brute_force(*rows))

    check()
    made = index.split(60)
    after = {r["arxiv_id"]: r["cell"] for r in index.papers().collect()}
    assert made > 0 and index.papers().count() == 400 and after.keys() == before.keys()
    assert len(set(after.values()) - set(before.values())) > 0
    # a third of the papers are copies: they stay together
    assert len({after[f"p{i:04d}"] for i in range(0, 400, 3)}) == 1
    check()
    index.append(papers.where(half).withColumn("arxiv_id", F.concat(F.lit("z"), "arxiv_id")))
    assert index.papers().count() == 400 + papers.where(half & F.col("arxiv_id").startswith("p")).count()


def test_a_cell_of_copies_cannot_be_split(spark, tmp_path):
    papers = spark.range(100).select(F.col("id").cast("string").alias("arxiv_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    index = CellIndex.create(papers, str(tmp_path / "index"), dim=2)
    assert index.split(10) == 0 and index.papers().count() == 100
