"""Quality classifier: a factorisation machine over words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pair sum is 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2), so a
document costs its number of features times the rank, not its square.

Features: words hashed into ``WORDS`` places (log counts of unit length);
structure statistics of the whole text, each as one of ``BINS`` quantile bins;
metadata: the bin of the stated character count and whether it fits the text.

Cases: a null or empty text has no words and the lowest bins, and gets a score
like any other; a null character count is its own feature; repeated rows get
equal scores; labels other than 0 and 1, and null ids, are not learned from;
with no label of one class every score is the smoothed share of label 1; very
long texts are described whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import TEXT_ROWS, batches_of, id_bucket, set_aside, stored

WORDS = 4096
BINS = 10
RANK = 8
#: Learned from at most so many documents of each label (lowest hash of the id).
SAMPLE_PER_LABEL = 4000
#: Texts that a task turns into Python strings at a time.
TEXTS = 64

STATISTICS = (
    "words", "word_length", "upper", "digit", "punctuation", "space", "beyond_ascii",
    "distinct_words", "top_word", "distinct_pairs", "line_length", "distinct_lines",
    "ended_lines", "capital_lines", "short_words", "long_words", "repeated_next", "stated_chars",
)
SIZE = WORDS + len(STATISTICS) * BINS + 2


def _place(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % WORDS


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 other, 1 upper, 2 digit, 3 space, 4 ASCII punctuation; beyond ASCII by letter case only."""
    kinds = np.zeros(0x110000, np.uint8)
    for code in range(0x3000):
        char = chr(code)
        kinds[code] = 1 if char.isupper() else 2 if char.isdigit() else 3 if char.isspace() else 0
        if code < 128 and not char.isalnum() and not char.isspace():
            kinds[code] = 4
    return kinds


def describe(text: str | None, stated: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and weights of the words, and the statistics, of one whole text."""
    text = text or ""
    words = text.lower().split()
    count = Counter(words)
    n = len(words)
    weight: dict[int, float] = {}
    for word, times in count.items():
        place = _place(word)
        weight[place] = weight.get(place, 0.0) + times
    places = np.fromiter(weight.keys(), np.int32, len(weight))
    values = np.log1p(np.fromiter(weight.values(), np.float32, len(weight)))
    if n:
        values /= np.sqrt(np.square(values).sum())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_classes()[codes], minlength=5) if len(codes) else np.zeros(5)
    chars = max(1, len(codes))
    lines = [line for line in text.split("\n") if line.strip()]
    some = max(1, len(lines))
    most = max(1, n)
    lengths = np.fromiter(map(len, words), np.int32, n)
    statistics = np.array([
        np.log1p(n),
        lengths.mean() if n else 0.0,
        kinds[1] / chars, kinds[2] / chars, kinds[4] / chars, kinds[3] / chars,
        float((codes > 127).sum()) / chars,
        len(count) / most,
        max(count.values(), default=0) / most,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        np.log1p(n / some),
        len(set(lines)) / some,
        sum(line.rstrip()[-1] in ".!?:;\"'" for line in lines) / some,
        sum(line.lstrip()[0].isupper() for line in lines) / some,
        float((lengths <= 2).sum()) / most,
        float((lengths >= 12).sum()) / most,
        sum(map(str.__eq__, words, words[1:])) / max(1, n - 1),
        np.log1p(max(0.0, stated)) if stated is not None and stated == stated else -1.0,
    ], np.float32)
    return places, values, statistics


def _binned(statistics: np.ndarray, edges: np.ndarray, chars_given: bool, fits: bool) -> np.ndarray:
    """Places of the bins of one document, and of its metadata flag."""
    bins = (statistics[:, None] > edges).sum(axis=1)
    flag = WORDS + len(STATISTICS) * BINS + (0 if not chars_given else 1)
    places = WORDS + np.arange(len(STATISTICS)) * BINS + bins
    return np.append(places, flag) if not (chars_given and fits) else places


@dataclass
class Machine:
    """A fitted machine; about 150 kB whatever it was learned from."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def features(self, text, stated) -> tuple[np.ndarray, np.ndarray]:
        places, values, statistics = describe(text, stated)
        given = statistics[-1] >= 0
        fits = bool(given and abs(float(stated) - len(text or "")) < 0.5)
        bins = _binned(statistics, self.edges, bool(given), fits)
        share = np.full(len(bins), 1.0 / np.sqrt(len(STATISTICS)), np.float32)
        return np.concatenate([places, bins]), np.concatenate([values, share])

    def scores(self, texts: list, stated: list) -> np.ndarray:
        """Scores of some texts, all in one array operation over their features."""
        return _sigmoid(self.raw([self.features(t, s) for t, s in zip(texts, stated)]))

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The sums under the sigmoid of some rows (places, values); a row has one feature at least."""
        first = np.cumsum([0] + [len(places) for places, _ in rows[:-1]])
        places = np.concatenate([places for places, _ in rows])
        values = np.concatenate([values for _, values in rows]).astype(float)
        spread = self.factors[places] * values[:, None]
        total = np.add.reduceat(spread, first)
        pairs = 0.5 * (np.square(total) - np.add.reduceat(np.square(spread), first)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[places] * values, first) + pairs


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _fit_machine(rows: list[tuple], labels: np.ndarray, weights: np.ndarray, *, epochs: int = 6) -> Machine:
    """Adagrad on the weighted logistic loss; the same rows give the same machine."""
    statistics = np.stack([row[2] for row in rows])
    edges = np.quantile(statistics, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    machine = Machine(
        0.0, np.zeros(SIZE, np.float32),
        np.random.default_rng(7).normal(0, 0.05, (SIZE, RANK)).astype(np.float32), edges,
    )
    sparse = []
    for places, values, stats, given, fits in rows:
        bins = _binned(stats, edges, given, fits)
        share = np.full(len(bins), 1.0 / np.sqrt(len(STATISTICS)))
        sparse.append((np.concatenate([places, bins]), np.concatenate([values, share])))
    mean = float(np.average(labels, weights=weights))
    machine.bias = float(np.log(mean / (1 - mean)))
    seen = [np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32)]
    seen_bias = 1e-6
    order = np.random.default_rng(11)
    for _ in range(epochs):
        turn = order.permutation(len(rows))
        for start in range(0, len(turn), 128):
            chosen = turn[start : start + 128]
            x = np.zeros((len(chosen), SIZE), np.float32)
            for i, row in enumerate(chosen):
                x[i, sparse[row][0]] = sparse[row][1]
            hidden = x @ machine.factors
            squares = np.square(x)
            raw = machine.bias + x @ machine.linear + 0.5 * (np.square(hidden) - squares @ np.square(machine.factors)).sum(1)
            error = ((_sigmoid(raw) - labels[chosen]) * weights[chosen] / len(chosen)).astype(np.float32)
            by_linear = error @ x + 1e-6 * machine.linear
            by_factors = x.T @ (error[:, None] * hidden) - machine.factors * (error @ squares)[:, None] + 1e-5 * machine.factors
            seen[0] += np.square(by_linear)
            seen[1] += np.square(by_factors)
            seen_bias += error.sum() ** 2
            machine.linear -= 0.2 * by_linear / np.sqrt(seen[0])
            machine.factors -= 0.05 * by_factors / np.sqrt(seen[1])
            machine.bias -= 0.1 * error.sum() / np.sqrt(seen_bias)
    return machine


def _arrays(lists: pa.ChunkedArray):
    """The values of each list, without Python objects of them."""
    return (one.values.to_numpy() for chunk in lists.chunks for one in chunk)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    learn_from: Column | None = None,
    sample_per_label: int = SAMPLE_PER_LABEL,
) -> Machine:
    """Fit a machine on a bounded sample of labelled documents.

    ``labels`` has doc_id and quality (0 or 1). ``learn_from`` is a condition on
    doc_id. At most ``sample_per_label`` documents of each label are read back
    to the driver, as hashed features; weights give the sample the shares that
    the labels have in the whole table.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if learn_from is not None:
        known = known.where(learn_from)
    known = known.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
    shares = {row["_label"]: row["n"] for row in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        total = sum(shares.values())
        mean = (shares.get(1, 0) + 1) / (total + 2)
        return Machine(
            float(np.log(mean / (1 - mean))), np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32),
            np.zeros((len(STATISTICS), BINS - 1), np.float32),
        )
    chosen = [
        known.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(sample_per_label)
        for label in (0, 1)
    ]
    chosen = chosen[0].unionByName(chosen[1])
    feature_type = "places array<int>, weights array<float>, statistics array<float>, given boolean, fits boolean"

    @F.pandas_udf(feature_type)
    def features(text: pd.Series, stated: pd.Series) -> pd.DataFrame:
        made = [describe(t, s) for t, s in zip(text, stated)]
        given = [bool(m[2][-1] >= 0) for m in made]
        fits = [bool(g and abs(float(s) - len(t or "")) < 0.5) for g, t, s in zip(given, text, stated)]
        return pd.DataFrame({
            "places": [m[0] for m in made], "weights": [m[1] for m in made], "statistics": [m[2] for m in made],
            "given": given, "fits": fits,
        })

    stated = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    examples = (
        docs.select(F.col("doc_id"), F.col("text"), stated.alias("_stated"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select("_label", F.xxhash64("_id", "text").alias("_order"), features("text", "_stated").alias("f"))
        .orderBy("_order", "_label")
        .limit(2 * sample_per_label)
    )
    with batches_of(docs.sparkSession, TEXT_ROWS):
        examples = examples.select("_label", "f.*").toArrow()
    rows = [
        (places.astype(np.int64), weights.astype(float), statistics, given, fits)
        for places, weights, statistics, given, fits in zip(
            *(_arrays(examples.column(name)) for name in ("places", "weights", "statistics")),
            *(examples.column(name).to_pylist() for name in ("given", "fits")),
        )
    ]
    y = examples.column("_label").to_numpy().astype(float)
    if len(set(y)) < 2:
        return train(docs, labels.limit(0))
    total = sum(shares.values())
    weights = np.array([shares[int(label)] / total * len(y) / (y == label).sum() for label in y])
    return _fit_machine(rows, y, weights)


def with_score(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) of each whole text."""

    @F.arrow_udf("double")
    def scored(text: pa.Array, stated: pa.Array) -> pa.Array:
        made = [
            machine.scores(text.slice(first, TEXTS).to_pylist(), stated.slice(first, TEXTS).to_pylist())
            for first in range(0, len(text), TEXTS)
        ]
        pa.default_memory_pool().release_unused()
        return pa.array(np.concatenate(made) if made else np.zeros(0), pa.float64())

    stated = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.withColumn(column, scored(F.col("text"), stated))


def keep(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is ``least`` or more; stored, as texts go to Python in small batches."""
    rows, names = set_aside(docs)
    inputs = [F.col(f"_in{docs.columns.index(name)}").alias(name) for name in ("text", "n_chars") if name in docs.columns]
    scored = with_score(rows.select(*rows.columns, *inputs), machine, "score")
    return stored(scored.where(F.col("score") >= least).select(*rows.columns), "good", TEXT_ROWS).select(*names)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Learned from ids whose crc32 modulo 3 is not 1; a null id is not held out.
    """
    machine = train(docs, labels, learn_from=id_bucket("doc_id", 3) != 1)
    narrow = docs.select("doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    scored = with_score(narrow, machine, "score").select(
        "doc_id",
        F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
    return stored(scored, "scores", TEXT_ROWS)
