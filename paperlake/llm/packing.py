"""Best-fit-decreasing packing of tokenised documents into sequences.

Pieces are taken by falling length; each goes into the open sequence with the
least room that still holds it, found in logarithmic time by a segment tree over
remaining capacities, or opens a new one.

Only lengths decide a packing, and there are at most ``capacity`` of them. So
the driver packs the table of lengths and counts, placing equal pieces in whole
runs of equal sequences: its work and the plan depend on the capacity, not on
the corpus. Executors tokenise, number the pieces of each length, and look up
the sequence and offset of a number in the plan.

Cases: a null or empty text is the end id alone; repeated rows are packed each
for itself; equal lengths go in order of their block, id and piece; an empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.common import TEXT_ROWS, stored

CAPACITY = 2048
END = 0
#: White space that the vocabulary does not split at as str.split() does,
#: signs that lower-case or compose in other ways, and the opening of a special token.
_NOT_PLAIN = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u0130\u0250-\U0010ffff]|<\\|")
_CONTROLS = "\x0b\x0c\x1c\x1d\x1e\x1f"
_BLANKS = re.compile(r"[ \t\r\n]+")
#: Fixed value: signs after a word that the vocabulary's splitting rule takes as one run,
#: all of ASCII but the apostrophe; anything else between blanks but letters and these
#: goes through the whole tokenizer.
_SIGNS = '.,;:!?|()"-*$%&#@^~+=/\\[]{}_`<>'
#: Signs that a text without neighbouring signs is split at before it is cut
#: into runs, and what each ASCII byte is for that: a sign (,) or anything else.
_SPLIT = [(sign, f" {sign} ") for sign in ",.;:!?"]
_KINDS = bytes(ord(",") if 32 < b < 127 and not chr(b).isalnum() else ord("a") for b in range(256))
#: Words and other runs whose ids a Python worker keeps at most, and the longest of them.
WORDS_KEPT, SIGNED_KEPT, LONGEST = 100_000, 50_000, 40
#: Bits that remember what was met once. Once half of the room is taken, a run is kept from its second meeting on.
MET_BITS = 1 << 24
#: Texts that a task turns into Python strings at a time.
TEXTS = 256


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies use for each byte: itself, or one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


class Runs(dict):
    """Ids by lower-case run (what stands between two blanks), kept for the next time.

    Most runs occur once. So that they don't take all the room, the second half
    of it is for runs that come back.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = self.tokenizer.model.tokenize
        self.bytes = _byte_signs()
        self.signed = 0
        self.met = bytearray(MET_BITS // 8)

    def _worth_keeping(self, run: str, held: int, most: int) -> bool:
        if len(run) > LONGEST or held >= most:
            return False
        if held < most // 2:
            return True
        at = hash(run) % MET_BITS
        bit = 1 << (at & 7)
        seen = self.met[at >> 3] & bit
        self.met[at >> 3] |= bit
        return bool(seen)

    def __missing__(self, run: str) -> bytes:
        if run.isalpha():
            shown = run if run.isascii() else "".join(map(self.bytes.__getitem__, run.encode()))
            ids = _as_bytes([piece.id for piece in self.pieces(shown)])
            if self._worth_keeping(run, len(self) - self.signed, WORDS_KEPT):
                self[run] = ids
        else:
            word = run.rstrip(_SIGNS)
            signs = run[len(word) :]
            if not signs or word and not word.isalpha():
                ids = self.whole(run)
            elif word:
                ids = self[word] + self[signs]
            else:
                ids = _as_bytes([piece.id for piece in self.pieces(run)])
            if self._worth_keeping(run, self.signed, SIGNED_KEPT):
                self.signed += 1
                self[run] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return _as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)


_FORMATS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _as_bytes(ids: list[int]) -> bytes:
    return _FORMATS[len(ids)](*ids) if len(ids) < len(_FORMATS) else struct.pack(f"<{len(ids)}I", *ids)


def _is_plain(text: str) -> bool:
    """No character that splits, lower-cases or composes in another way than str does it."""
    if text.isascii():
        return "<|" not in text and not any(sign in text for sign in _CONTROLS)
    return _NOT_PLAIN.search(text) is None


def _has_neighbouring_signs(text: str) -> bool:
    """True if two signs stand together in a plain text, or may do so beyond ASCII."""
    data = text.encode()
    if len(data) > len(text) and (b"\xc2" in data or b"\xc3\x97" in data or b"\xc3\xb7" in data):
        return True
    return b",," in data.translate(_KINDS)


def _runs_of(text: str) -> list[str]:
    """Runs of a plain text. A sign without a sign beside it is one for itself, so words come without it."""
    lower = text.lower()
    if not _has_neighbouring_signs(lower):
        for sign, apart in _SPLIT:
            lower = lower.replace(sign, apart)
    return lower.split()


class Encoder:
    """Ids of a text, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and case and splits at blanks, so what
    stands between two blanks can be encoded for itself: words of letters and
    signs after them by the tokenizer's model, anything else by all of it. A sign
    that stands alone is split off first: words with it needn't be kept beside
    those without.
    """

    def __init__(self, path: str):
        self.runs = Runs(path)

    def __call__(self, text: str) -> bytes:
        if _is_plain(text):
            return b"".join(map(self.runs.__getitem__, _runs_of(text)))
        return b"".join(map(self.runs.whole, filter(None, _BLANKS.split(text))))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document.

    A document has one piece at least, so the outer generator gives the inner one's
    rows. For the inner one Spark filters empty arrays out first, and for that filter
    tokenises every text a second time, in a second Python worker.
    """

    @F.arrow_udf("array<struct<length: int, crc: long>>")
    def cut(text: pa.Array) -> pa.Array:
        encode, step, end = encoder(tokenizer), 4 * capacity, np.array([END], "<u4").tobytes()
        sizes, lengths, sums = [0], [], []
        for first in range(0, len(text), TEXTS):
            for t in text.slice(first, TEXTS).to_pylist():
                ids = (encode(t) if t else b"") + end
                for at in range(0, len(ids), step):
                    lengths.append(min(step, len(ids) - at) // 4)
                    sums.append(crc32(ids[at : at + step]))
                sizes.append(len(lengths))
        pieces = pa.StructArray.from_arrays(
            [pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())], ["length", "crc"]
        )
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pieces)

    return (
        docs.select("doc_id", cut(F.col("text")).alias("cut"))
        .select("doc_id", F.posexplode_outer("cut").alias("piece", "cut"))
        .select(
            "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
            F.col("cut.length").cast("long").alias("length"), F.col("cut.crc").alias("ids_crc32"),
        )
    )


class Capacities:
    """Segment tree over capacities 0 to ``most``: the least one from x on that is in use."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.used = [False] * (2 * self.leaves)

    def set(self, capacity: int, used: bool) -> None:
        node = self.leaves + capacity
        self.used[node] = used
        while node > 1:
            node //= 2
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def least(self, x: int) -> int | None:
        if x >= self.leaves:
            return None
        node = self.leaves + x
        if self.used[node]:
            return x
        while node > 1:
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.used[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length the runs (first number, first sequence, pieces a sequence, offset there)."""
    tree, free = Capacities(capacity), [[] for _ in range(capacity + 1)]
    plan: dict[int, np.ndarray] = {}
    opened = 0

    def keep(first: int, n: int, room: int) -> None:
        if n and room:
            free[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, done, runs = counts[length], 0, []
        while left:
            room = tree.least(length)
            if room is None:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                first, n = free[room].pop()
                if not free[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            runs.append((done, first, each, capacity - room))
            if full:
                keep(first, full, room - each * length)
                done, left = done + full * each, left - full * each
            if left and full < n:
                if full:
                    runs.append((done, first + full, each, capacity - room))
                keep(first + full, 1, room - left * length)
                done, left, full = done + left, 0, full + 1
            keep(first + full, n - full, room)
        plan[length] = np.array(runs, np.int64)
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = stored(pieces(docs, tokenizer, capacity).withColumn("block", F.spark_partition_id()), "pieces", TEXT_ROWS)
    counts = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = best_fit_plan({row["length"]: row["n"] for row in totals}, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, numbers = length.to_numpy(), number.to_numpy()
        for one in np.unique(lengths):
            here = np.flatnonzero(lengths == one)
            runs = plan[int(one)]
            run = runs[np.searchsorted(runs[:, 0], numbers[here], side="right") - 1]
            along = numbers[here] - run[:, 0]
            sequence[here] = run[:, 1] + along // run[:, 2]
            offset[here] = run[:, 3] + along % run[:, 2] * one
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    numbered = cut.withColumn("row", F.row_number().over(within)).join(bases, ["length", "block"])
    return numbered.withColumn("at", place(F.col("length"), F.col("base") + F.col("row") - 1)).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"),
    )
