"""The nearest rows of a block of vectors, as small helpers for Arrow tasks.

Spark decides which papers meet which questions; the helpers here only multiply
two bounded matrices and keep the best ``k`` per question, so a task never emits
or holds all pairs of its group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Distances that agree to this many places count as equal; the id then decides.
TIE_PLACES = 12

# Stands for a null topic; no id is the least 64-bit number.
NO_TOPIC = -(2**63)

# Questions multiplied at a time: bounds the matrix of one step.
STRIP = 512

# Papers whose products give a first bound of a search.
FIRST_LOOK = 1024

# Candidate pairs of one step beyond which the bound is tightened over all papers.
MANY_PAIRS = 250_000


def unit_matrix(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors and those vectors at length 1, in double.

    Not usable are null vectors, vectors with a null element, zero vectors, and
    those of another length than ``dim`` (default: the first length seen).
    """
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    if dim is None:
        present = lengths[lengths > 0]
        dim = int(present[0]) if len(present) else 1
    rows = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(rows)).flatten() if len(rows) else pa.array([], pa.float64())
    matrix = (
        flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    )
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    usable = np.isfinite(norms) & (norms > 0)
    return rows[usable], matrix[usable] / norms[usable, None]


def distances(papers: np.ndarray, questions: np.ndarray) -> np.ndarray:
    """Cosine distances of unit vectors, papers down, questions across."""
    return np.clip(np.round(1.0 - papers @ questions.T, TIE_PLACES), 0.0, 2.0)


def without_spare_copies(
    ids: pa.Array, papers: np.ndarray, topics: np.ndarray, most: int
) -> np.ndarray:
    """Row numbers of a block without the copies that cannot be among ``most`` hits.

    Papers with the same vector and topic are equally far from every question, so
    of more than ``most`` of them only those with the least ids can be hits.
    """
    rows = np.ascontiguousarray(papers).view(np.dtype((np.void, papers.shape[1] * 8))).ravel()
    _, group, sizes = np.unique(rows, return_inverse=True, return_counts=True)
    copied = np.flatnonzero(sizes[group] > most)
    if not len(copied):
        return np.arange(len(papers))
    copies = pd.DataFrame({
        "row": copied,
        "group": group[copied],
        "topic": topics[copied],
        "id": ids.take(pa.array(copied)).to_pylist(),
    }).sort_values("id")
    spare = copies.groupby(["group", "topic"], dropna=False).cumcount() >= most
    return np.setdiff1d(np.arange(len(papers)), copies["row"][spare].to_numpy())


def paper_block(
    ids: pa.Array, vectors: pa.Array, topics: pa.Array, dim: int, most: int
) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, unit vectors and topics of the papers that can be among ``most`` hits."""
    rows, unit = unit_matrix(vectors, dim)
    ids, numbers = ids.take(pa.array(rows)), topic_array(topics)[rows]
    if len(rows) <= most:
        return ids, unit, numbers
    kept = without_spare_copies(ids, unit, numbers, most)
    return ids.take(pa.array(kept)), unit[kept], numbers[kept]


class Nearest:
    """The ``k`` nearest papers seen so far for each of a strip of questions.

    What is farther than the ``reach`` of its question is not kept. Products in single precision, widened by their greatest possible error,
    leave few candidates; the distances of those are taken in double.
    """

    def __init__(self, k: int, questions: np.ndarray, reach: np.ndarray):
        self.k = k
        self.reach = reach
        self.questions = questions
        self.single = questions.astype(np.float32)
        self.slack = 2.5e-7 * (questions.shape[1] + 4)
        self.least = 1.0 - reach  # cosine of the k-th hit; -inf while it is unknown
        self.kept = None

    def _kth_cosine(self, cosines: np.ndarray) -> np.ndarray:
        at = cosines.shape[1] - self.k
        return np.partition(cosines, at, axis=1)[:, at]

    def add(self, ids: pa.Array, papers: np.ndarray, single: np.ndarray) -> None:
        cosines = self.single @ single.T
        least = self.least
        if np.isneginf(least).any() and len(papers) >= self.k:
            seen = cosines[:, : max(FIRST_LOOK, self.k)]
            least = np.maximum(least, self._kth_cosine(seen) - self.slack)
        near = cosines >= (least - self.slack)[:, None].astype(np.float32)
        if np.count_nonzero(near) > MANY_PAIRS and len(papers) >= self.k:
            least = np.maximum(least, self._kth_cosine(cosines) - self.slack)
            near = cosines >= (least - self.slack)[:, None].astype(np.float32)
        q, row = np.nonzero(near)
        if not len(q):
            return
        away = pair_distances(self.questions, q, papers, row)
        order = np.lexsort((away, q))
        q, row, away = q[order], row[order], away[order]
        wanted = away <= np.minimum(self._kth_distance(q, away), self.reach[q])
        q, row, away = q[wanted], row[wanted], away[wanted]
        new = pd.DataFrame({"q": q, "distance": away, "id": ids.take(pa.array(row)).to_pylist()})
        both = new if self.kept is None else pd.concat([self.kept, new])
        both = both.sort_values(["q", "distance", "id"], kind="stable")
        self.kept = both[both.groupby("q").cumcount() < self.k].reset_index(drop=True)
        last = self.kept[self.kept.groupby("q").cumcount() == self.k - 1]
        q, away = last["q"].to_numpy(), last["distance"].to_numpy()
        self.least[q] = np.maximum(self.least[q], 1.0 - away)

    def _kth_distance(self, q: np.ndarray, away: np.ndarray) -> np.ndarray:
        """Per pair, the ``k``-th distance of its question; pairs are in that order."""
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        sizes = np.diff(np.r_[starts, len(q)])
        kth = away[starts + np.minimum(sizes, self.k) - 1]
        return np.repeat(np.where(sizes >= self.k, kth, np.inf), sizes)


def pair_distances(
    questions: np.ndarray, q: np.ndarray, papers: np.ndarray, row: np.ndarray
) -> np.ndarray:
    """Distances of the given pairs, some at a time."""
    found = np.empty(len(q))
    step = max(1, 1_000_000 // papers.shape[1])
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        found[part] = np.einsum("ij,ij->i", questions[q[part]], papers[row[part]])
    return np.clip(np.round(1.0 - found, TIE_PLACES), 0.0, 2.0)


class Searches:
    """Searches for a set of questions, each in all papers or in those of its topic.

    ``wanted`` is the number of hits per question; ``topics`` is NO_TOPIC for all
    papers; ``reach`` is a distance that its last hit is known not to exceed.
    """

    def __init__(
        self, wanted: np.ndarray, questions: np.ndarray, topics: np.ndarray, reach: np.ndarray | None = None
    ):
        self.wanted = wanted
        self.reach = np.full(len(wanted), np.inf) if reach is None else reach
        self.everywhere = self._strips(questions, np.flatnonzero(topics == NO_TOPIC))
        self.in_topic = {
            topic: self._strips(questions, np.flatnonzero(topics == topic))
            for topic in np.unique(topics[topics != NO_TOPIC])
        }

    def _strips(self, questions: np.ndarray, numbers: np.ndarray):
        # questions of one strip want equally many hits
        strips = []
        for k in np.unique(self.wanted[numbers]):
            alike = numbers[self.wanted[numbers] == k]
            for at in range(0, len(alike), STRIP):
                some = alike[at : at + STRIP]
                strips.append((some, Nearest(int(k), questions[some], self.reach[some])))
        return strips

    def add(self, ids: pa.Array, papers: np.ndarray, topics: np.ndarray) -> None:
        if not len(papers) or not len(self.wanted):
            return
        single = papers.astype(np.float32)
        for _, search in self.everywhere:
            search.add(ids, papers, single)
        if not self.in_topic:
            return
        for topic in np.unique(topics[topics != NO_TOPIC]):
            strips = self.in_topic.get(topic)
            if strips:
                rows = np.flatnonzero(topics == topic)
                some = ids.take(pa.array(rows))
                for _, search in strips:
                    search.add(some, papers[rows], single[rows])

    def found(self, question_ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch | None:
        """What was kept, as rows of question id, paper id, distance, hits wanted."""
        strips = [*self.everywhere, *(s for group in self.in_topic.values() for s in group)]
        parts = [(numbers, s.kept) for numbers, s in strips if s.kept is not None]
        if not parts:
            return None
        asked = np.concatenate([numbers[kept["q"].to_numpy()] for numbers, kept in parts])
        ids = [i for _, kept in parts for i in kept["id"]]
        away = np.concatenate([kept["distance"].to_numpy() for _, kept in parts])
        return pa.RecordBatch.from_arrays(
            [
                question_ids.take(pa.array(asked)).cast(schema.field(0).type),
                pa.array(ids, schema.field(1).type),
                pa.array(away, pa.float64()),
                pa.array(self.wanted[asked], pa.int32()),
            ],
            schema=schema,
        )


def topic_array(topics: pa.Array) -> np.ndarray:
    """Topic ids as 64-bit integers, NO_TOPIC for null."""
    return pc.fill_null(topics.cast(pa.int64()), NO_TOPIC).to_numpy(zero_copy_only=False)
