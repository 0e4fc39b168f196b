"""Removal of long repeated byte strings by a sparse, distributed suffix sort.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else. To sort one suffix for every byte is not affordable, so a suffix
stands for a run of neighbouring starts:

* Each start p looks at the ``reach`` places from p on and takes the one with
  the least hash as its anchor. The anchor and the ``length - reach + 1`` bytes
  from it on lie inside the string at p, so equal strings have equal anchors.
* Runs of starts with one anchor are the suffixes that are sorted. Their leading
  token is a hash of the bytes from the anchor on, the next one a hash of the
  bytes that all strings of the run cover. Spark samples splitters and
  range-partitions by these tokens (then by text and place, which splits tokens
  that very many suffixes share); a task sorts its bucket by multikey quicksort.
* Neighbours that agree in both tokens repeat as a whole. Those that agree in the
  first only are open: their bytes, and those of one witness for each class of
  neighbours, go on to the next round with a smaller ``reach``. First and last
  runs of a bucket may agree with the next bucket's, and stay open too.
* In the last round reach is 1, and a suffix is one start with two independent
  64-bit hashes of its string; there the first and last of each bucket are
  compared across the boundaries.

Equal texts have equal results, so places are kept by text (80 bits of hash).

Cases: a null text is an empty one; a text shorter than ``length`` loses
nothing; matches don't cross documents; a repeated row is an occurrence of its
own; equally long repeats are removed alike; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import chunks, set_aside, stored
from paperlake.llm.hashing import Substrings, mixed

LENGTH = 400
REACHES = (128, 16, 1)
GRAM = 16
SEGMENT_BYTES = 1_000_000
#: Suffixes that a task sorts, about; more of them make more buckets.
BUCKET_SUFFIXES = 1_000_000
#: Starts between two open runs up to which their bytes are kept as one piece.
GAP = 32
SUFFIXES = "k long, c long, h long, pos long, width int"


def _sliding_min(x: np.ndarray, reach: int) -> np.ndarray:
    """Least of x[i] to x[i + reach - 1], by doubling; reach is a power of 2."""
    step = 1
    while step < reach:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x


def runs(texts: list[bytes], length: int, reach: int):
    """(text number, first start, starts, first token, second token) of every run of every text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 5
    # Starts whose string lies inside their text.
    valid = np.zeros(n + 1, np.int8)
    long_enough = sizes >= length
    np.add.at(valid, base[long_enough], 1)
    np.add.at(valid, (base + sizes - length + 1)[long_enough], -1)
    starts = np.flatnonzero(np.cumsum(valid[:n]))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    one = Substrings(data, by_word=True)
    if reach == 1:
        first, last, anchor = starts, starts, starts
    else:
        places = np.arange(n - GRAM + 1)
        rank = one.of(places, places + GRAM) & np.uint64(0xFFFFFFFFFF000000) | places.astype(np.uint64)
        least = (_sliding_min(rank, reach)[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (np.diff(least) != 0) | (np.diff(starts) != 1)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(starts)) - 1
        first, last, anchor = starts[begin], starts[end], least[begin]
    head = one.of(anchor, anchor + length - reach + 1)
    if reach == 1:
        around = Substrings(data, 2, by_word=True).of(first, last + length)
    else:
        shape = ((anchor - first) * 1024 + (last - first)).astype(np.uint64)
        around = mixed(one.of(first, last + length) ^ shape * np.uint64(0x9E3779B97F4A7C15))
    text = np.searchsorted(base, first, side="right") - 1
    # Empty texts share their base with the next one; the last of equal bases is meant.
    return text, first - base[text], last - first + 1, head.view(np.int64), around.view(np.int64)


def _segments(text: bytes, length: int):
    """(offset, bytes) of a text, in stretches that overlap so that no string is lost."""
    for at in range(0, max(1, len(text) - length + 1), SEGMENT_BYTES):
        yield at, text[at : at + SEGMENT_BYTES + length - 1]


def _suffixes(pieces: DataFrame, length: int, reach: int) -> DataFrame:
    """Suffixes of ``pieces`` (h, tail, start, bytes); pos is place * 2^16 + tail."""

    def run(batches):
        for batch in batches:
            h, tail, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            parts = (
                (i, at, part)
                for i, text in enumerate(batch.column(3).to_pylist()) if len(text) >= length
                for at, part in _segments(text, length)
            )
            for some in chunks(parts, lambda p: len(p[2]), SEGMENT_BYTES):
                text, place, width, k, c = runs([p[2] for p in some], length, reach)
                row = np.array([p[0] for p in some], np.int64)[text]
                place = place + np.array([p[1] for p in some], np.int64)[text] + start[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k), pa.array(c), pa.array(h[row]), pa.array(place * 65536 + tail[row]),
                     pa.array(width.astype(np.int32))],
                    ["k", "c", "h", "pos", "width"],
                )

    return pieces.select("h", "tail", "start", "bytes").mapInArrow(run, SUFFIXES)


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order by several keys: each next key is sorted only among rows equal in all before it."""
    order = np.argsort(columns[0], kind="quicksort")
    group = np.zeros(len(order), np.int64)
    for before, column in zip(columns, columns[1:]):
        values = before[order]
        group = np.cumsum(np.concatenate([[0], (np.diff(values) != 0) | (np.diff(group) != 0)])) if len(order) else group
        tied = np.bincount(group, minlength=1)[group] > 1
        rows = order[tied]
        order[tied] = rows[np.lexsort((column[rows], group[tied]))]
    return order


def _runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run of equal rows that each row is in, and the size of each run."""
    fresh = np.zeros(len(columns[0]), bool)
    for column in columns:
        fresh[1:] |= column[1:] != column[:-1]
    number = np.cumsum(fresh)
    return number, np.bincount(number, minlength=1)


def _bucket(last_round: bool):
    """What a sorted bucket says of its suffixes: whole (repeats), open, or edge (last round)."""

    def run(batches):
        tables = [pa.Table.from_batches([batch]) for batch in batches]
        if not tables or not sum(map(len, tables)):
            return
        table = pa.concat_tables(tables)
        del tables
        k, c, h, pos, width = (table.column(i).to_numpy() for i in range(5))
        order = multikey_order([k, c, h, pos])
        k, c, h, pos, width = (x[order] for x in (k, c, h, pos, width))
        of_k, many_k = _runs_of(k)
        of_c, many_c = _runs_of(k, c)
        whole = many_c[of_c] > 1
        edge_run = (of_k == 0) | (of_k == of_k[-1])
        if last_round:
            edge = np.zeros(len(k), bool)
            edge[[0, -1]] = True
            open_ = np.zeros(len(k), bool)
        else:
            edge = np.zeros(len(k), bool)
            classes = np.bincount(of_k[np.concatenate([[0], np.flatnonzero(np.diff(of_c)) + 1])])
            open_ = (many_k[of_k] > 1) & (classes[of_k] > 1) | edge_run
            # Of a class that repeats as a whole one witness is enough.
            first_of_c = np.concatenate([[True], of_c[1:] != of_c[:-1]])
            open_ &= ~whole | first_of_c
        copy = np.zeros(len(k), bool)
        copy[1:] = (of_c[1:] == of_c[:-1]) & (h[1:] == h[:-1]) & (pos[1:] == pos[:-1])
        keep = (whole | open_ | edge) & (~copy | open_ | edge)
        for at in np.array_split(np.flatnonzero(keep), max(1, int(keep.sum()) // 50_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[at]) for x in (k, c, h, pos, width, whole, open_, edge)],
                ["k", "c", "h", "pos", "width", "whole", "open", "edge"],
            )

    return run


def _buckets(pieces: DataFrame, reach: int) -> int:
    """How many buckets the suffixes ask for: an anchor lasts about half of its reach."""
    size = pieces.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    return -(-2 * size // ((reach + 1) * BUCKET_SUFFIXES))


def _sorted(suffixes: DataFrame, buckets: int, last_round: bool, label: str) -> DataFrame:
    usual = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ("k", "c", "h", "pos")
    parted = suffixes.repartitionByRange(buckets, *key) if buckets > usual else suffixes.repartitionByRange(*key)
    return stored(
        parted.mapInArrow(_bucket(last_round), SUFFIXES + ", whole boolean, open boolean, edge boolean"), label
    )


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("h", F.xxhash64("bytes")).withColumn("tail", F.pmod(F.hash("bytes"), F.lit(65536)).cast("long"))


def _open_pieces(pieces: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Bytes of the open runs of ``found``, cut from ``pieces``."""
    wanted = (
        found.where("open")
        .select(
            F.col("h").alias("of_h"), (F.col("pos") % 65536).alias("of_tail"),
            F.struct(F.floor(F.col("pos") / 65536).cast("long").alias("at"), F.col("width").cast("long").alias("n")).alias("run"),
        )
        .groupBy("of_h", "of_tail")
        .agg(F.sort_array(F.collect_set("run")).alias("runs"))
    )
    joined = pieces.join(wanted, (F.col("h") == F.col("of_h")) & (F.col("tail") == F.col("of_tail")))

    def cut(batches):
        for batch in batches:
            rows = []
            for h, tail, start, data, runs_ in zip(*(batch.column(i).to_pylist() for i in range(5))):
                begin = end = None
                for run in runs_:
                    a = max(run["at"] - start, 0)
                    b = min(run["at"] + run["n"] - 1 - start, len(data) - length)
                    if b < a:
                        continue
                    if end is not None and a <= end + GAP:
                        end = max(end, b)
                        continue
                    if end is not None:
                        rows.append((h, tail, start + begin, data[begin : end + length]))
                    begin, end = a, b
                if end is not None:
                    rows.append((h, tail, start + begin, data[begin : end + length]))
            for some in chunks(rows, lambda r: len(r[3]), 8_000_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in some], kind) for i, kind in
                     enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["h", "tail", "start", "bytes"],
                )

    return joined.select("h", "tail", "start", "bytes", "runs").mapInArrow(
        cut, "h long, tail long, start long, bytes binary"
    )


def repeated(docs: DataFrame, *, length: int = LENGTH, reaches: tuple[int, ...] = REACHES) -> DataFrame:
    """h, tail (of a text's bytes) and the stretches (at, end) that repeated strings cover."""
    pieces = _with_key(docs.where(F.octet_length("bytes") >= length)).select(
        "h", "tail", F.lit(0).cast("long").alias("start"), "bytes"
    )
    covered = None
    for turn, reach in enumerate(reaches):
        last_round = reach == 1
        found = _sorted(_suffixes(pieces, length, reach), _buckets(pieces, reach), last_round, f"suffixes-{reach}")
        whole = found.where("whole")
        if last_round:
            edges = found.where("edge").groupBy(F.col("k").alias("edge_k"), F.col("c").alias("edge_c")).agg(
                F.count("*").alias("n")
            )
            across = found.where("edge and not whole").join(
                F.broadcast(edges.where("n > 1")), (F.col("k") == F.col("edge_k")) & (F.col("c") == F.col("edge_c")), "left_semi"
            )
            whole = whole.unionByName(across)
        else:
            pieces = stored(_open_pieces(pieces, found, length), f"pieces-{reach}")
        place = F.floor(F.col("pos") / 65536).cast("long")
        spans = whole.select(
            "h", (F.col("pos") % 65536).alias("tail"), place.alias("at"), (place + F.col("width") + length - 1).alias("end")
        )
        covered = spans if covered is None else covered.unionByName(spans)
    return covered.groupBy("h", "tail").agg(F.sort_array(F.collect_set(F.struct("at", "end"))).alias("spans"))


def _merged(spans: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for span in spans if spans is not None else ():
        if out and span["at"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span["end"])
        else:
            out.append([span["at"], span["end"]])
    return [(a, b) for a, b in out]


def _kept_parts(data: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    ends = [0, *(b for _, b in spans)]
    begins = [*(a for a, _ in spans), len(data)]
    return [data[a:b] for a, b in zip(ends, begins)]


def removed(docs: DataFrame, *, length: int = LENGTH, column: str = "kept", bytes_too: bool = True) -> DataFrame:
    """All columns of ``docs`` and a struct: n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes (or null)."""
    at = docs.columns.index("text")
    rows, names = set_aside(docs)
    rows = rows.withColumn("bytes", F.coalesce(F.col(f"_in{at}").cast("string"), F.lit("")).cast("binary"))
    found = repeated(rows.select("bytes"), length=length).select(
        F.col("h").alias("of_h"), F.col("tail").alias("of_tail"), "spans"
    )
    joined = _with_key(rows).join(found, (F.col("h") == F.col("of_h")) & (F.col("tail") == F.col("of_tail")), "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def cut(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(data, spans):
            merged = _merged(own)
            kept = b"".join(_kept_parts(text, merged))
            out.append((len(text), len(text) - len(kept), len(merged), sha256(kept).hexdigest(), kept if bytes_too else None))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.withColumn("cut", cut("bytes", "spans")).select(*names, F.col("cut").alias(column))


def measure(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and repeated (anything removed) of every document."""
    found = removed(docs.select("doc_id", "text"), length=length, column="cut", bytes_too=False)
    return found.select(
        "doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256", (F.col("cut.n_removed") > 0).alias("repeated")
    )
