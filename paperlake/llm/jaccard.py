"""Jaccard self-join of shingle sets with a token-group matrix.

1. Texts with equal sets become one representative.
2. Shingles are ordered, common ones last. Two sets that link share a shingle
   among the first n - ceil(t * n) + 1 of each (n: size, t: threshold). Only
   representatives that share such a shingle with another go on.
3. Each goes to a group: that of the most shared of its first shingles and of its
   size, divided into parts of at most about ``GROUP_ROWS``, so that similar sets
   are together.
4. The token-group matrix holds, for each group, the union of its members' first
   shingles, once each, and the least and largest size.
5. A representative meets the matrix by its first shingles. The number that it
   shares with a union, and all its other shingles, bound its intersection with
   any member; it opens only groups where that can reach the threshold, and of
   two groups only one opens the other.
6. In an opened group whole sets are compared. What leaves a group is one link a
   representative and connected part of the group, enough for the components.

A very large family of near copies that share their first shingles costs its
number of members times the number of its groups.

Cases: a null text or one without words has an empty set, is linked with nothing
and is its own component; texts with fewer words than a shingle have one of all
their words; repeated rows link; the component of rows whose ids are all null is
null; ids that repeat over different texts don't link these.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from paperlake.llm.common import TEXT_ROWS, chunks, set_aside, stored
from paperlake.llm.components import components
from paperlake.llm.hashing import mixed, shingles
from paperlake.session import fits

GROUP_ROWS = 256
#: Sizes in a group differ by about one in so many; the bounds on a group are the better for it.
BANDS = 100
#: Queries that meet a group in one task.
QUERY_ROWS = 1024
#: Buckets in which the frequency of shingles is counted; only their order depends on it.
BUCKETS = 1 << 18
#: Bytes that are hashed at a time, and texts that a task takes from Arrow at a time.
BATCH_BYTES, TEXTS = 256_000, 64
#: A text has a word, and so a shingle, if this is found in it.
A_WORD = r"[^\x20\x09-\x0D]"
#: Representatives up to which their ids are sent to the scan of the texts.
BROADCAST_ROWS = 300_000


def _sets(texts: pa.Array, words: int):
    """(first row, rows, text number, hash) for stretches of a column of texts."""
    done = 0
    encoded = (
        text or b""
        for first in range(0, len(texts), TEXTS)
        for text in texts.slice(first, TEXTS).cast(pa.binary()).to_pylist()
    )
    for some in chunks(encoded, len, BATCH_BYTES):
        text, token = shingles(some, words)
        yield done, len(some), text, token
        done += len(some)
    pa.default_memory_pool().release_unused()


def _signatures(count: int, text: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit sums of each set, and its size."""
    bounds = np.searchsorted(text, np.arange(count + 1))
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(token) + 1, np.uint64)
        np.cumsum(mixed(token * np.uint64(salt) + np.uint64(salt >> 7)), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1], np.diff(bounds)


def _first(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of n decide: n - ceil(percent * n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def _text_hashes(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")


def _read(docs: DataFrame, words: int) -> DataFrame:
    """One pass: doc_id, text hashes, signature and size of each document, and bucket counts of each task."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            for start, count, text, token in _sets(batch.column("text"), words):
                s1, s2, n = _signatures(count, text, token)
                counts += np.bincount((token >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, count), *(batch.column(t).slice(start, count) for t in ("t1", "t2")),
                     pa.array(s1), pa.array(s2), pa.array(n.astype(np.int64)), pa.nulls(count, pa.int32())],
                    ["doc_id", "t1", "t2", "s1", "s2", "n", "bucket"],
                )
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(at), id_type), *(pa.nulls(len(at), pa.int64()) for _ in range(4)),
             pa.array(counts[at]), pa.array(at.astype(np.int32))],
            ["doc_id", "t1", "t2", "s1", "s2", "n", "bucket"],
        )

    text = F.col("text").cast("string")
    narrow = docs.select("doc_id", text.alias("text"), *_text_hashes(text))
    kind = narrow.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    return narrow.mapInArrow(
        run, f"doc_id {kind.simpleString()}, t1 long, t2 long, s1 long, s2 long, n long, bucket int"
    )


def _ranks(read: DataFrame) -> np.ndarray:
    """The place of each bucket among all, by its count, in 256 classes: common shingles come last."""
    counts = np.zeros(BUCKETS)
    found = read.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[found["bucket"].to_numpy(int)] = found["n"].to_numpy()
    edges = np.quantile(counts, np.linspace(0, 1, 257)[1:-1])
    return np.searchsorted(edges, counts, side="left").astype(np.uint8)


def _representatives(docs: DataFrame, ranks: np.ndarray, words: int, percent: int) -> DataFrame:
    """id, signature, size and first shingles of each distinct set; doc_id and text_hash of its first row."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for start, count, text, token in _sets(batch.column("text"), words):
                s1, s2, n = _signatures(count, text, token)
                order = np.lexsort((token, ranks[(token >> np.uint64(46)).astype(np.int64)], text))
                bounds = np.searchsorted(text, np.arange(count))
                place = np.arange(len(token)) - bounds[text]
                keep = place < _first(n, percent)[text]
                first = token[order][keep].view(np.int64)
                sizes = np.bincount(text[keep], minlength=count)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(first))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, count), batch.column("text_hash").slice(start, count),
                     pa.array(s1), pa.array(s2), pa.array(n.astype(np.int64)), lists],
                    ["doc_id", "text_hash", "s1", "s2", "n", "first"],
                ).filter(pa.array(n > 0))

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    rows = narrow.mapInArrow(run, f"doc_id {kind}, text_hash long, s1 long, s2 long, n long, first array<long>")
    one = rows.groupBy("s1", "s2").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n").alias("n"), F.first("first").alias("first")
    )
    named = one.select("row.doc_id", "row.text_hash", "s1", "s2", "n", "first", F.monotonically_increasing_id().alias("id"))
    return stored(named, "representatives", TEXT_ROWS)


def _whole_sets(docs: DataFrame, wanted: DataFrame, words: int, repeats: bool) -> DataFrame:
    """id and whole set of each representative in ``wanted``, from its text.

    ``repeats`` says that equal rows occur, of which one is then taken.
    """
    wanted = wanted.select(
        F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "id",
        F.col("s1").alias("of_s1"), F.col("s2").alias("of_s2"),
    )
    if fits(wanted, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.xxhash64("text") == F.col("of_hash"))
    )

    def run(batches):
        for batch in batches:
            ids, of1, of2 = batch.column("id"), batch.column("of_s1").to_numpy(), batch.column("of_s2").to_numpy()
            for start, count, text, token in _sets(batch.column("text"), words):
                s1, s2, n = _signatures(count, text, token)
                same = (s1 == of1[start : start + count]) & (s2 == of2[start : start + count])
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(start, count), lists], ["id", "tokens"]).filter(pa.array(same))

    made = rows.select("id", "of_s1", "of_s2", "text").mapInArrow(run, "id long, tokens array<long>")
    return made.dropDuplicates(["id"]) if repeats else made


def _linked(sizes_a, sizes_b, shared, percent: int):
    return 100 * shared >= percent * (sizes_a + sizes_b - shared)


def _intersections(asked: list[np.ndarray], members: list[np.ndarray]) -> np.ndarray:
    """Shared elements of each query with each member, through the members' postings."""
    all_tokens = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    order = np.argsort(all_tokens, kind="stable")
    all_tokens, owner = all_tokens[order], owner[order]
    out = np.zeros((len(asked), len(members)), np.int64)
    for i, tokens in enumerate(asked):
        low = np.searchsorted(all_tokens, tokens, side="left")
        n = np.searchsorted(all_tokens, tokens, side="right") - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[i] = np.bincount(owner[at], minlength=len(members))
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least connected row of each row of a symmetric matrix."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            root[i] = i
            todo = [i]
            while todo:
                near = np.flatnonzero(linked[todo.pop()] & (root < 0))
                root[near] = i
                todo.extend(near.tolist())
    return root


def _compare(percent: int):
    """Links of a group's members among themselves, and of the queries that open it."""

    def run(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        if members.empty:
            return none
        sets = members["own"].tolist()
        ids, sizes = members["member"].to_numpy(), np.array([len(s) for s in sets])
        inner = _linked(sizes[:, None], sizes[None, :], _intersections(sets, sets), percent)
        root = _roots(inner)
        links = [(ids[root != np.arange(len(ids))], ids[root[root != np.arange(len(ids))]])]
        if len(asked):
            theirs = asked["theirs"].tolist()
            outer = _linked(
                np.array([len(s) for s in theirs])[:, None], sizes[None, :], _intersections(theirs, sets), percent
            )
            row, column = np.nonzero(outer)
            if len(row):
                pairs = np.unique(np.stack([row, root[column]]), axis=1)
                links.append((asked["query"].to_numpy()[pairs[0]], ids[pairs[1]]))
        a, b = (np.concatenate([x[i] for x in links]) for i in (0, 1))
        return pd.DataFrame({"a": a.astype("int64"), "b": b.astype("int64")}) if len(a) else none

    return run


def link(docs: DataFrame, *, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents, roots): doc_id, text hashes, s1, s2 and n of every document; s1, s2 and root of the linked ones."""
    read = stored(_read(docs, words), "shingle-counts", TEXT_ROWS)
    ranks = _ranks(read)
    representatives = _representatives(docs, ranks, words, percent)
    first = representatives.select(F.explode("first").alias("token"), "id")
    shared = stored(
        first.withColumn("sharing", F.count("*").over(Window.partitionBy("token"))).where(F.col("sharing") > 1), "shared"
    )
    homes = shared.groupBy("id").agg(F.max(F.struct("sharing", "token")).alias("home"))
    grouped = stored(
        homes.join(representatives.drop("first"), "id").select(
            "id", "n", "doc_id", "text_hash", "s1", "s2",
            F.xxhash64(
                "home.token",
                F.floor(F.log("n") * BANDS),
                F.pmod(F.xxhash64("id"), F.ceil(F.col("home.sharing") / GROUP_ROWS)),
            ).alias("group"),
        ),
        "groups",
    )
    placed = shared.select("token", "id").join(grouped.select("id", "n", "group"), "id")
    matrix = placed.groupBy("token", "group").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("holders")
    )
    matrix = matrix.select(F.col("token").alias("of_token"), F.col("group").alias("of_group"), "least", "most", "holders")
    met = placed.join(
        matrix,
        (F.col("token") == F.col("of_token"))
        & ((F.col("group") > F.col("of_group")) | ((F.col("group") == F.col("of_group")) & (F.col("holders") > 1)))
        & (100 * F.col("most") >= percent * F.col("n"))
        & (100 * F.col("n") >= percent * F.col("least")),
    )
    met = met.groupBy("id", "of_group").agg(
        F.count("*").alias("common"), F.first("n").alias("n"), F.first("group").alias("group"),
        F.min("least").alias("least"), F.max("most").alias("most"),
    )
    # Of two sets, all that the one with the lower last first shingle has among its
    # first ones and shares is counted; so its others bound the rest.
    beyond = F.ceil(F.greatest("n", F.least(F.col("most"), 100 * F.col("n") / percent)) * percent / 100 - 1e-9).cast("long") - 1
    needed = F.ceil((F.col("n") + F.greatest(F.col("least"), percent * F.col("n") / 100)) * percent / (100.0 + percent) - 1e-9)
    opened = stored(
        met.where(F.col("common") + beyond >= needed).select(
            F.col("id").alias("query"), "of_group", (F.col("group") != F.col("of_group")).alias("from_outside")
        ),
        "opened",
    )
    busy = opened.groupBy("of_group").agg(F.count_if("from_outside").alias("queries"))
    parts = busy.select(
        F.col("of_group").alias("part_group"),
        F.greatest(F.ceil(F.col("queries") / QUERY_ROWS), F.lit(1).cast("long")).alias("parts"),
    )
    placing = (
        grouped.join(parts, F.col("group") == F.col("part_group"))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select(F.col("id").alias("member"), F.col("group").alias("in_group"), F.col("part").alias("in_part"))
    )
    wanted = placing.select(F.col("member").alias("id")).unionByName(opened.select(F.col("query").alias("id"))).distinct()
    known = read.where(F.col("bucket").isNull()).groupBy("doc_id", "s1", "s2").agg(F.count("*").alias("rows"))
    repeats = not known.where("rows > 1").isEmpty()
    sets = stored(_whole_sets(docs, grouped.join(wanted, "id", "left_semi"), words, repeats), "sets", TEXT_ROWS)
    members = placing.join(sets, F.col("member") == F.col("id")).select(
        "member", "in_group", "in_part", F.col("tokens").alias("own")
    )
    asking = (
        opened.where("from_outside")
        .join(parts, F.col("of_group") == F.col("part_group"))
        .withColumn("of_part", F.pmod(F.xxhash64("query"), F.col("parts")))
        .join(sets, F.col("query") == F.col("id"))
        .select("query", F.col("of_group").alias("to_group"), F.col("of_part").alias("to_part"), F.col("tokens").alias("theirs"))
    )
    links = (
        members.groupBy("in_group", "in_part")
        .cogroup(asking.groupBy("to_group", "to_part"))
        .applyInPandas(_compare(percent), "a long, b long")
    )
    return read.where(F.col("bucket").isNull()).drop("bucket"), _named(links, representatives)


def _named(links: DataFrame, representatives: DataFrame) -> DataFrame:
    """(s1, s2, root) of every representative that links to another."""
    roots = components(links)
    return roots.join(representatives.select("id", "s1", "s2"), F.col("node") == F.col("id")).select(
        F.col("s1").alias("of_s1"), F.col("s2").alias("of_s2"), "root"
    )


def joined(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    read, roots = link(docs, words=words, percent=percent)
    # A document's component: that of its set's links, else of its set alone,
    # else (an empty set) itself.
    rows = read.join(roots, (F.col("s1") == F.col("of_s1")) & (F.col("s2") == F.col("of_s2")), "left").select(
        "doc_id", "n",
        F.when(F.col("root").isNotNull(), F.struct(F.col("root").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("k")))
        .when(F.col("n") > 0, F.struct(F.col("s1").alias("x"), F.col("s2").alias("y"), F.lit(1).alias("k")))
        .alias("class"),
    )
    rows = stored(rows, "classes")
    least = rows.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("component"))
    least = least.withColumnRenamed("class", "of_class")
    return rows.join(least, F.col("class") == F.col("of_class"), "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each component: the one with the least doc_id.

    Rows with an empty set are linked with nothing and all stay. Where several
    rows of a component have its least id, that with the least set, and of equal
    rows one, stays; a null id is least of all.
    """
    read, roots = link(docs, words=words, percent=percent)
    rows = read.join(roots, (F.col("s1") == F.col("of_s1")) & (F.col("s2") == F.col("of_s2")), "left")
    full = rows.where(F.col("n") > 0)
    grouped = full.groupBy(
        F.coalesce(F.col("root"), F.col("s1")).alias("x"), F.when(F.col("root").isNull(), F.col("s2")).alias("y")
    )
    least = grouped.agg(F.min(F.struct("doc_id", "s1", "s2")).alias("keep")).select(
        F.col("keep.doc_id").alias("keep_id"), F.col("keep.s1").alias("keep_s1"), F.col("keep.s2").alias("keep_s2")
    )
    # All texts with that id and set, as a row is found again by its text.
    kept = stored(
        full.select("doc_id", "s1", "s2", "t1", "t2")
        .join(
            least,
            F.col("doc_id").eqNullSafe(F.col("keep_id"))
            & (F.col("s1") == F.col("keep_s1"))
            & (F.col("s2") == F.col("keep_s2")),
        )
        .groupBy("keep_id", "keep_s1", "keep_s2", F.col("t1").alias("keep_t1"), F.col("t2").alias("keep_t2"))
        .agg(F.count("*").alias("copies")),
        "kept",
    )
    return _rows_of(docs, kept)


def _rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an empty set, and one row for each id and set of ``kept`` (id, set, text hashes).

    No text goes to Python here, and where no id and set has several rows none is shuffled.
    """
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    rows, names = set_aside(docs)
    text = F.col(f"_in{text_at}").cast("string")
    one = ("keep_id", "keep_s1", "keep_s2")
    repeats = not kept.groupBy(*one).agg(F.sum("copies").alias("rows")).where("rows > 1").isEmpty()
    rows = rows.withColumn("empty", ~F.coalesce(text.rlike(A_WORD), F.lit(False))).select("*", *_text_hashes(text))
    kept = kept.drop("copies")
    found = rows.join(
        F.broadcast(kept) if fits(kept, BROADCAST_ROWS) else kept,
        F.col(f"_in{id_at}").eqNullSafe(F.col("keep_id"))
        & (F.col("t1") == F.col("keep_t1"))
        & (F.col("t2") == F.col("keep_t2")),
        "left",
    ).where(F.col("empty") | F.col("keep_s1").isNotNull())
    if repeats:
        each = F.when(F.col("empty"), F.monotonically_increasing_id())
        within = Window.partitionBy(f"_in{id_at}", "keep_s1", "keep_s2", each).orderBy(f"_in{text_at}")
        found = found.withColumn("turn", F.row_number().over(within)).where(F.col("turn") == 1)
    return found.select(*names)
