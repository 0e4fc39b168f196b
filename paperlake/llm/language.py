"""Language identification of mixed-language text.

The script of a word leaves as candidates the languages that use it; the log
probabilities of its character trigrams score those alone, and Viterbi with a penalty for each change of
language labels the words. Runs of one label are the spans; the language with
most letters is the document's.

Cases: a null text or one without a letter is ``und`` with score 0 and has no
spans; rows with a null or empty language are not learned from; a script that no
learned language uses leaves all of them as candidates; ties go to the first
language in order of name; with nothing learned every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import chunks, id_bucket

SLOTS = 1 << 15
SWITCH = 10.0
UNKNOWN = "und"
#: Characters that a task takes up at a time.
CHARS = 2_000_000

# First and last code point of the ranges of some scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ("other",)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and the number of its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    script = np.full(0x110000, len(NAMES) - 1, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return letter, script


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters, and the slot of the trigram around each; other characters count as blanks."""
    letter = _letters()[0][codes]
    shown = np.where(letter, codes, 32).astype(np.uint32)
    mixed = shown * np.uint32(0x9E3779B1)
    mixed[1:] ^= shown[:-1] * np.uint32(0x85EBCA77)
    mixed[0] ^= np.uint32(32 * 0x85EBCA77 & 0xFFFFFFFF)
    mixed[:-1] ^= (shown[1:] + np.uint32(7)) * np.uint32(0xC2B2AE3D)
    mixed[-1] ^= np.uint32(39 * 0xC2B2AE3D & 0xFFFFFFFF)
    mixed ^= mixed >> np.uint32(15)
    at = np.flatnonzero(letter)
    return at, (mixed[at] * np.uint32(0x2C1B3C6D)) >> np.uint32(17)


@dataclass
class Model:
    """Log probabilities by language and slot, and whether a script (row) is used by a language."""

    names: list[str]
    logs: np.ndarray
    scripts: np.ndarray

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, share of letters, and spans (start, end, language) of each text."""
        if not self.names:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        lowered = [_codes(t) for t in texts]
        sizes = np.fromiter((len(c) + 1 for c in lowered), np.int64, len(texts))
        base = np.cumsum(sizes) - sizes
        codes = np.full(int(sizes.sum()), 10, np.uint32)
        for start, part in zip(base, lowered):
            codes[start : start + len(part)] = part
        at, slots = _trigrams(codes)
        if not len(at):
            return [(UNKNOWN, 0.0, [])] * len(texts)
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        begin = at[first]
        length = np.diff(np.append(first, len(at)))
        score = np.full((len(first), len(self.names)), -np.inf, np.float32)
        script = _letters()[1][codes[begin]]
        for one in np.unique(script):
            mine = np.flatnonzero(script == one)
            own = slots if len(mine) == len(first) else slots[np.repeat(script == one, length)]
            ends = np.cumsum(length[mine])
            for k in np.flatnonzero(self.scripts[one]):
                score[mine, k] = np.add.reduceat(self.logs[k][own], ends - length[mine])
        bounds = np.searchsorted(begin, np.append(base, len(codes)))
        path = viterbi(score, bounds, SWITCH)
        return [
            self._summary(path[a:b], begin[a:b] - start, length[a:b])
            for a, b, start in zip(bounds[:-1], bounds[1:], base)
        ]

    def _summary(self, path, begin, length):
        if not len(path):
            return UNKNOWN, 0.0, []
        letters = np.bincount(path, weights=length, minlength=len(self.names))
        best = int(letters.argmax())
        edge = np.flatnonzero(np.diff(path.astype(np.int64), prepend=-1))
        ends = (begin + length)[np.append(edge[1:] - 1, len(path) - 1)]
        spans = [(int(a), int(b), self.names[path[i]]) for a, b, i in zip(begin[edge], ends, edge)]
        return self.names[best], float(letters[best] / letters.sum()), spans


def viterbi(score: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word; the words of text i are rows bounds[i] to bounds[i + 1].

    All texts advance together, a word at a time, longest first, so that the
    work of one step is one array operation over the texts not yet at their end.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    start, lengths = bounds[:-1][order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left") if len(lengths) else []
    kind = np.min_scalar_type(max(0, score.shape[1] - 1))
    came = np.empty(score.shape, kind)
    own = np.arange(score.shape[1], dtype=kind)
    best = np.zeros((len(lengths), score.shape[1]), np.float32)
    for step, n in enumerate(active):
        rows = start[:n] + step
        now = best[:n]
        top = now.argmax(1)
        changed = now[np.arange(n), top][:, None] - (switch if step else 0.0)
        stay = now >= changed
        came[rows] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, now, changed) + score[rows]
    path = np.empty(len(score), kind)
    state = best.argmax(1) if len(lengths) else None
    for step in range(len(active) - 1, -1, -1):
        n = active[step]
        rows = start[:n] + step
        path[rows] = state[:n]
        state[:n] = came[rows, state[:n]]
    return path


def train(docs: DataFrame, *, learn_from: Column | None = None) -> Model:
    """Trigram and script counts of every document with a language.

    Counts are summed in each task and then by Spark; what reaches the driver is
    at most SLOTS + scripts numbers a language, whatever the corpus.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != ""))
    if learn_from is not None:
        known = known.where(learn_from)

    def count(batches):
        letter_scripts = _letters()[1]
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                total = held.setdefault(lang, np.zeros(SLOTS + len(NAMES), np.int64))
                for some in chunks(texts, len, CHARS):
                    codes = _codes("\n".join(some))
                    if not len(codes):
                        continue
                    at, slots = _trigrams(codes)
                    total[:SLOTS] += np.bincount(slots, minlength=SLOTS)
                    total[SLOTS:] += np.bincount(letter_scripts[codes[at]], minlength=len(NAMES))
        for lang, total in held.items():
            slot = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "slot": slot.astype(np.int32), "n": total[slot]})

    counted = (
        known.select("lang", "text")
        .mapInPandas(count, "lang string, slot int, n long")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    names = sorted(counted["lang"].unique())
    logs = np.zeros((len(names), SLOTS), np.float32)
    scripts = np.zeros((len(NAMES), len(names)), bool)
    for k, name in enumerate(names):
        mine = counted[counted["lang"] == name]
        total = np.zeros(SLOTS + len(NAMES))
        total[mine["slot"].to_numpy()] = mine["n"].to_numpy()
        logs[k] = np.log((total[:SLOTS] + 0.1) / (total[:SLOTS].sum() + 0.1 * SLOTS))
        used = total[SLOTS:] >= 0.01 * max(1.0, total[SLOTS:].sum())
        scripts[:, k] = used
    scripts[~scripts.any(axis=1)] = True
    return Model(names, logs, scripts)


def with_language(docs: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """All columns of ``docs`` and a struct of lang, score and spans.

    Spans are start and end in characters of the lower-cased text, and a language.
    """

    @F.pandas_udf("lang string, score double, spans array<struct<start: int, end: int, lang: string>>")
    def labelled(text: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in text]
        found = [x for some in chunks(texts, len, CHARS) for x in model.label(some)]
        return pd.DataFrame({
            "lang": [x[0] for x in found],
            "score": [x[1] for x in found],
            "spans": [[{"start": a, "end": b, "lang": name} for a, b, name in x[2]] for x in found],
        })

    return docs.withColumn(column, labelled(F.col("text")))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learned from ids whose crc32 modulo 5 is not 0; a null id is not held out
    and not learned from.
    """
    model = train(docs, learn_from=id_bucket("doc_id", 5) != 0)
    return with_language(docs.select("doc_id", "text"), model, "found").select(
        "doc_id",
        F.coalesce(id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )
