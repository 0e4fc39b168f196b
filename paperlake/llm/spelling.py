"""Spelling variants: words one edit apart, found by an index of variable-length grams.

* Words are counted in Spark, each task summing first.
* The gram dictionary holds the grams of 2 to ``longest`` characters that occur in
  many words; a gram that is not in it is rare enough and need not grow. Words
  stand between two marks, and the gram of a place is the shortest from there on
  that is not in the dictionary, so it depends on its own characters alone.
* One edit therefore changes only grams that cover its place. The most grams that
  cover one place is a word's bound: two near words share all but that many grams
  of either, so both hold a common gram among their rarest bound + 1. These go
  into the inverted lists, by gram, place and word length: an inserted character
  moves the grams behind it by one.
* A list is merged in a task: grams of two words are compared as 64-bit signatures
  (a gram that only one of them has changes at most one bit), and what the bounds
  of both leave is verified character by character. Only near words leave a task.
* A list longer than ``LIST_WORDS`` is cut into blocks, and each pair of blocks is
  a task's work; nothing is dropped.

Cases: null and empty texts, and texts of other scripts, hold no words; a null
id counts as an empty one; repeated rows count again; words of any length are
kept whole; of equally frequent near words the first in code-point order is the
form; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import stored
from paperlake.llm.utf8 import slices, text_bytes
from paperlake.operators.lookups import salted

# Letters are A-Z, a-z and U+00C0 to U+00FF (in UTF-8 the lead
# byte C3); one run in 97 loses a character.
LEAD, LOSES = 0xC3, 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
SHORTEST_GRAM, LONGEST_GRAM = 2, 4
BEGIN, END = "\x02", "\x03"
#: A gram is in the dictionary if it occurs in more words than this, and than
#: this share of all places of the words; so the dictionary is bounded.
FREQUENT, DICTIONARY_GRAMS = 50, 50_000
#: Words of an inverted list that are compared in one task, and pairs at a time.
LIST_WORDS, PAIRS = 8_192, 1_000_000
SLICE_BYTES = 4_000_000
#: Runs of up to this many bytes are handled as arrays, words of up to so many characters compared as such.
SHORT, WIDE = 16, 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_ALL = np.uint32(0xFFFFFFFF)


def _changed(run: bytes, crc: int) -> str:
    word = run.decode("utf-8", "replace")
    at = crc % len(word)
    return word[:at] + word[at + 1 :] if crc % LOSES == 0 else word


def _words(data: np.ndarray, at: np.ndarray, ids: list, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Counter]:
    """Words of some texts: bytes, sizes and counts of the short ones, and a count of the others."""
    data = _LOWER[data]
    lead = data == LEAD
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    edges = at[(at > 0) & (at < len(data))]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edges], after[edges - 1] = False, False
    first, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    enough = end - first - (leads[end] - leads[first]) >= least
    first, end = first[enough], end[enough]
    length = end - first
    begun = np.array([crc32(b"" if i is None else b"%d" % i) for i in ids], np.uint32)
    begun = np.array([crc32(b":", int(c)) for c in begun], np.uint32)
    crc = begun[np.searchsorted(at, first, side="right") - 1]
    other: Counter = Counter()
    for i in np.flatnonzero(length > SHORT):
        run = data[first[i] : end[i]].tobytes()
        other[_changed(run, crc32(run, int(crc[i])))] += 1
    order = np.argsort(-length, kind="stable")
    order = order[np.searchsorted(-length[order], -SHORT, side="left") :]
    first, length, crc = first[order], length[order], crc[order] ^ _ALL
    shown = np.zeros((len(order), SHORT), np.uint8)
    for place in range(SHORT):
        n = int(np.searchsorted(-length, -place, side="left"))
        shown[:n, place] = data[first[:n] + place]
        crc[:n] = _CRC[(crc[:n] ^ shown[:n, place]) & 255] ^ (crc[:n] >> np.uint32(8))
    crc ^= _ALL
    loses = crc % LOSES == 0
    for run, size, own in zip(shown[loses], length[loses], crc[loses]):
        other[_changed(run[:size].tobytes(), int(own))] += 1
    keys = shown[~loses].view(">u8").astype(np.uint64)
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    begin = np.flatnonzero(fresh)
    distinct = keys[begin].astype(">u8").view(np.uint8).reshape(-1, SHORT)
    filled = distinct != 0
    return distinct[filled], filled.sum(axis=1), np.diff(np.append(begin, len(keys))), other


def words(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n (occurrences) of every word of the texts that is long and frequent enough."""

    def count(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, at = text_bytes(batch.column(1))
            for a, b in slices(at, SLICE_BYTES):
                part = data[at[a] : at[b]]
                if not len(part):
                    continue
                shown, sizes, n, other = _words(part, at[a : b + 1] - at[a], ids[a:b], least_length)
                places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                short = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(shown)])
                yield pa.RecordBatch.from_arrays([short.cast(pa.string(), safe=False), pa.array(n, pa.int64())], ["word", "n"])
                if other:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(other), pa.string()), pa.array(list(other.values()), pa.int64())], ["word", "n"]
                    )

    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))
    )


def dictionary(found: DataFrame, longest: int = LONGEST_GRAM, *, frequent: int = FREQUENT) -> dict[str, int]:
    """The frequent grams and their counts; of each length at most ``DICTIONARY_GRAMS`` can be frequent."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                marked = f"{BEGIN}{word}{END}"
                for size in range(SHORTEST_GRAM, longest + 1):
                    held.update(marked[p : p + size] for p in range(len(marked) - size + 1))
            if len(held) > 500_000:
                yield _counted(held)
                held = Counter()
        yield _counted(held)

    places = found.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    least = max(frequent, places // DICTIONARY_GRAMS)
    counted = found.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {row["gram"]: row["n"] for row in counted.where(F.col("n") > least).collect()}


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"]
    )


def grams(word: str, frequent: dict[str, int], longest: int = LONGEST_GRAM) -> list[tuple[int, str]]:
    """(place, gram) of every place of a marked word: the shortest gram from there that is not frequent."""
    marked = f"{BEGIN}{word}{END}"
    out = []
    for place in range(len(marked) - 1):
        size = SHORTEST_GRAM
        while size < longest and place + size < len(marked) and marked[place : place + size] in frequent:
            size += 1
        out.append((place, marked[place : place + size]))
    return out


def affected(own: list[tuple[int, str]]) -> int:
    """The most grams that an edit at one place can change: those that cover it."""
    change = np.zeros(len(own) + 2 + max(len(g) for _, g in own), np.int64)
    for place, gram in own:
        change[place] += 1
        change[place + len(gram)] -= 1
    return int(np.cumsum(change)[1 : len(own)].max())


def _indexed(found: DataFrame, frequent: dict[str, int], longest: int) -> DataFrame:
    """word, n, size, signature of all grams, bound, and the rarest bound + 1 grams with their places."""
    held = found.sparkSession.sparkContext.broadcast(frequent)

    def decompose(batches):
        known = held.value
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1)
            size, signature, bound, rare = [], [], [], []
            for word in names:
                own = grams(word, known, longest)
                most = affected(own)
                marks = 0
                for _, gram in own:
                    marks |= 1 << (crc32(gram.encode()) & 63)
                own.sort(key=lambda x: (known.get(x[1], 0), x[1], x[0]))
                size.append(len(word))
                signature.append(marks - (1 << 64) if marks >> 63 else marks)
                bound.append(most)
                rare.append([{"gram": gram, "place": place} for place, gram in own[: most + 1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), counts, pa.array(size, pa.int32()), pa.array(signature, pa.int64()),
                 pa.array(bound, pa.int32()),
                 pa.array(rare, pa.list_(pa.struct([("gram", pa.string()), ("place", pa.int32())])))],
                ["word", "n", "size", "signature", "bound", "rare"],
            )

    kinds = "word string, n long, size int, signature long, bound int, rare array<struct<gram: string, place: int>>"
    return found.select("word", "n").mapInArrow(decompose, kinds)


def _lists(indexed: DataFrame) -> DataFrame:
    """The inverted lists: a word of their length is a member; one a character shorter visits, here or a place later."""
    ways = F.array(*[
        F.struct(
            F.lit(later).alias("later"), F.lit(longer).alias("longer"),
        ) for later, longer in ((0, 0), (0, 1), (1, 1))
    ])
    rows = indexed.select("word", "n", "size", "signature", "bound", F.explode("rare").alias("own"), ways.alias("ways"))
    rows = rows.select("word", "n", "size", "signature", "bound", "own", F.explode("ways").alias("way"))
    return rows.select(
        F.xxhash64("own.gram", F.col("own.place") + F.col("way.later"), F.col("size") + F.col("way.longer")).alias("k"),
        (F.col("way.longer") == 1).alias("visits"), "word", "n", "size", "signature", "bound",
    )


def _blocks(lists: DataFrame, list_words: int) -> DataFrame:
    """Lists dealt over (one, two), pairs of blocks; a list that is short enough is one block."""
    counts = lists.groupBy("k").agg(F.count("*").alias("rows"))
    long = counts.where(F.col("rows") > list_words).orderBy(F.desc("rows")).limit(10_000).collect()
    alone = {"block": F.lit(0), "one": F.lit(0), "two": F.lit(0)}
    if not long:
        return lists.withColumns(alone)
    known = lists.sparkSession.createDataFrame(
        [(row["k"], -(-row["rows"] // list_words)) for row in long], "k long, blocks int"
    )
    rows = lists.join(F.broadcast(known), "k", "left")
    rows = rows.withColumn("block", F.coalesce(F.pmod(F.xxhash64("word"), "blocks").cast("int"), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    return (
        rows.withColumn("other", other)
        .withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
        .drop("other", "blocks")
    )


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _verified(shown: np.ndarray, sizes: np.ndarray, names: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart; i is as long as j or one longer, and both are distinct words."""
    good = np.zeros(len(i), bool)
    wide = (sizes[i] > WIDE) | (sizes[j] > WIDE)
    for at in np.flatnonzero(wide):
        good[at] = one_edit(names[i[at]], names[j[at]])
    equal = np.flatnonzero(~wide & (sizes[i] == sizes[j]))
    good[equal] = (shown[i[equal]] != shown[j[equal]]).sum(axis=1) == 1
    longer = np.flatnonzero(~wide & (sizes[i] == sizes[j] + 1))
    if len(longer):
        long, short = shown[i[longer]], shown[j[longer]]
        ahead = long != short
        behind = long[:, 1:] != short[:, :-1]
        first = ahead.argmax(axis=1)
        last = behind.shape[1] - 1 - behind[:, ::-1].argmax(axis=1)
        good[longer] = ~behind.any(axis=1) | (last < first)
    return good


def _near_in(lists: pa.Table):
    """(word, near, near_n) of both words of every near pair of whole lists."""
    k, one, two, block = (lists.column(c).to_numpy() for c in ("k", "one", "two", "block"))
    visits, sizes = lists.column("visits").to_numpy(), lists.column("size").to_numpy()
    signature, n = lists.column("signature").to_numpy().view(np.uint64), lists.column("n").to_numpy()
    bound = lists.column("bound").to_numpy()
    names = np.array(lists.column("word").to_pylist(), object)
    shown = np.array([name[:WIDE] for name in names], f"U{WIDE + 1}").view(np.uint32).reshape(len(names), WIDE + 1)
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    begin = np.flatnonzero(fresh)
    ends = np.append(begin[1:], len(k))[np.cumsum(fresh) - 1]
    partners = np.where(visits, 0, ends - np.arange(len(k)) - 1)
    done = np.cumsum(partners)
    row = 0
    while row < len(k):
        upto = max(row + 1, int(np.searchsorted(done, (done[row - 1] if row else 0) + PAIRS, side="right")))
        many = partners[row:upto]
        i = np.repeat(np.arange(row, upto), many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + i + 1
        # A gram of only one of them sets or clears at most one bit; of either
        # word all but its bound are common.
        most = sizes[i] + sizes[j] + 2 - 2 * np.maximum(sizes[i] + 1 - bound[i], sizes[j] + 1 - bound[j])
        keep = np.bitwise_count(signature[i] ^ signature[j]) <= most
        keep &= (one[i] == two[i]) | (block[i] != block[j])
        i, j = i[keep], j[keep]
        good = _verified(shown, sizes, names, i, j)
        i, j = i[good], j[good]
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[np.concatenate([i, j])], pa.string()), pa.array(names[np.concatenate([j, i])], pa.string()),
                 pa.array(n[np.concatenate([j, i])], pa.int64())],
                ["word", "near", "near_n"],
            )
        row = upto


def _merged(batches):
    """Near words of sorted lists; a list that goes on in the next batch waits for it."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        key = [table.column(c).to_numpy() for c in ("k", "one", "two")]
        differs = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in key])) if len(table) else []
        whole = int(differs[-1]) + 1 if len(differs) else 0
        if whole:
            yield from _near_in(table.slice(0, whole))
        held = table.slice(whole).combine_chunks()
    if held is not None and len(held):
        yield from _near_in(held)


def near_words(
    found: DataFrame, *, least_length: int = LEAST_LENGTH, frequent: int = FREQUENT, list_words: int = LIST_WORDS
) -> DataFrame:
    """word, near and near_n: every pair of the given words that is one edit apart, both ways, once.

    ``found`` has word (distinct, of ``least_length`` or more, which is 2 at least) and n.
    """
    longest = min(LONGEST_GRAM, least_length)
    indexed = stored(_indexed(found, dictionary(found, longest, frequent=frequent), longest), "grams")
    lists = _blocks(_lists(indexed), list_words)
    dealt = lists.repartition("k", "one", "two").sortWithinPartitions("k", "one", "two", "visits")
    pairs = dealt.select("k", "one", "two", "block", "visits", "word", "n", "size", "signature", "bound").mapInArrow(
        _merged, "word string, near string, near_n long"
    )
    return pairs.dropDuplicates(["word", "near"])


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of every row of ``forms`` (word, form): pointers are doubled until none moves."""
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nexts = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = salted(state, nexts, "root")
        state = stored(
            moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("moved")


def variants(found: DataFrame, *, least_length: int = LEAST_LENGTH, times: int = 2, **how) -> DataFrame:
    """word, form, root, n, n_near and form_n of every given word.

    The form is the near word of largest n, if that is at least ``times`` the
    word's own; the root is where forms lead.
    """
    near = near_words(found, least_length=least_length, **how)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best")
    )
    is_form = -F.col("best.minus_n") >= times * F.col("n")
    judged = stored(
        found.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def measure(docs: DataFrame) -> DataFrame:
    """The variants of the words of all documents."""
    return variants(stored(words(docs), "words"))
