"""Benchmark decontamination by winnowing.

A text is read as words, once. Of its k-gram hashes the least of every ``reach``
neighbouring ones is kept; k + reach - 1 is the length of a window, so two texts
that share a window have kept a hash in common. Kept hashes of documents and
items are joined; only texts that meet an item are read again, and each hit is
extended to whole windows: those of the text are hashed, looked up among the
distinct windows of the items, and compared word by word. Items shorter than a
window are one window each, whose hash every text keeps at every place.

Texts are known by their digest, so equal texts are searched as one, and ids may
repeat or be null. Work grows with the words of both sides, also where one word
repeats: a window that occurs often in an item is one window.

Cases: a null text or one without words has no words and no hits; an item
without words has no windows; an item that occurs twice counts once; an item
with a null id marks words but isn't listed; without items nothing is hit; texts
of any length are read whole; repeated rows get equal results; other columns
keep their names and values; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.common import set_aside, stored
from paperlake.operators.lookups import lookup

WINDOW = 13
GRAM = 5
#: Hashes, digests and windows up to which they are sent to every task, rather than shuffled.
BROADCAST_ROWS = 500_000
#: First words of short items up to which places are skipped that no short item can begin at.
FIRST_WORDS = 10_000

# Fixed value: a word, once A-Z are lower-cased; and before that.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text; only A-Z are lower-cased."""
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _once(df: DataFrame, *new: Column) -> DataFrame:
    """The columns of ``df`` and new ones, computed once a row whatever reads them."""
    return df.select("*", F.inline(F.array(F.struct(*new))))


def _places(words: Column, size: int) -> Column:
    """1, 2, ... for each place at which ``size`` words begin."""
    some = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1))
    return F.coalesce(some, F.array().cast("array<int>"))


def _hashes(words: str, places: Column, size: int) -> Column:
    return F.transform(places, lambda i: F.xxhash64(F.lit(size), F.slice(words, i, size)))


def _kept(words: str, hashes: str, window: int, gram: int, short: list[int], firsts: list[int] | None) -> Column:
    """The hashes a text keeps: the least k-gram of every window, and all grams as long as a short item."""
    reach = window - gram + 1
    least = F.transform(_places(F.col(words), window), lambda i: F.array_min(F.slice(hashes, i, reach)))
    kept = [least]
    for size in short:
        places = _places(F.col(words), size)
        if firsts is not None:
            places = F.filter(places, lambda i: F.xxhash64(F.get(words, i - 1)).isin(firsts))
        kept.append(_hashes(words, places, size))
    return F.array_distinct(F.concat(*kept))


def _prints(read: DataFrame, window: int, gram: int, short: list[int], firsts: list[int] | None = None) -> DataFrame:
    """The columns of ``read``, which has words, with n_words and kept instead of the words."""
    hashed = _once(read, _hashes("words", _places(F.col("words"), gram), gram).alias("hashes"))
    others = [name for name in read.columns if name != "words"]
    return hashed.select(
        *others, F.size("words").alias("n_words"), _kept("words", "hashes", window, gram, short, firsts).alias("kept")
    )


def _windows(read: DataFrame, sizes: list[int], *own: str) -> DataFrame:
    """start (from 0), length, hash and words of each window of ``read``, which has words, with the columns ``own``."""

    def placed(size: int) -> Column:
        hashes = _hashes("words", _places(F.col("words"), size), size)
        return F.transform(hashes, lambda x, i: F.struct(i.alias("start"), F.lit(size).alias("length"), x.alias("hash")))

    each = [placed(size) for size in sizes]
    at = read.select(*own, "words", F.explode(F.concat(*each)).alias("at"))
    return at.select(*own, "at.*", F.slice("words", F.col("at.start") + 1, F.col("at.length")).alias("window"))


def _key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _read(docs: DataFrame) -> DataFrame:
    """``docs``, which has text, with words instead."""
    others = [name for name in docs.columns if name != "text"]
    words = F.coalesce(words_of(F.col("text")), F.array().cast("array<string>"))
    return _once(docs, words.alias("words")).select(*others, "words")


class Benchmark:
    """Items as windows: what texts are held against."""

    def __init__(self, items: DataFrame, window: int, gram: int):
        read = _read(items.where(F.col("text").isNotNull()).select("item_id", "text")).where(F.size("words") > 0)
        self.items = stored(read.dropDuplicates(["item_id", "words"]), "items")
        self.window, self.gram = window, gram
        below = self.items.where(F.size("words") < window)
        self.short = sorted(row["n"] for row in below.select(F.size("words").alias("n")).distinct().collect())
        firsts = below.select(F.xxhash64(F.get("words", F.lit(0))).alias("first")).distinct().limit(FIRST_WORDS + 1).collect()
        self.firsts = [row["first"] for row in firsts] if self.short and len(firsts) <= FIRST_WORDS else None
        whole = _windows(self.items.where(F.size("words") >= window), [window], "item_id")
        for size in self.short:
            whole = whole.unionByName(_windows(below.where(F.size("words") == size), [size], "item_id"))
        self.owners = stored(whole.drop("start").distinct(), "owners")

    def prints(self, read: DataFrame) -> DataFrame:
        return _prints(read, self.window, self.gram, self.short, self.firsts)

    def marks(self) -> DataFrame:
        """hash: every hash that a text with a window of an item may have kept."""
        whole = self.items.where(F.size("words") >= self.window)
        kept = _prints(whole, self.window, self.gram, []).select(F.explode("kept").alias("hash"))
        return kept.unionByName(self.owners.where(F.col("length") < self.window).select("hash")).distinct()

    def found(self, docs: DataFrame, prints: DataFrame) -> DataFrame:
        """key, n_words, n_hit and items (ids as sorted text) of every text of ``docs`` (key, text) with a hit.

        ``prints`` has key and kept.
        """
        kept = prints.select("key", F.explode("kept").alias("hash"))
        met = stored(lookup(kept, self.marks(), "hash", "left_semi", BROADCAST_ROWS).select("key").distinct(), "met")
        texts = lookup(docs.select("key", "text"), met, "key", "left_semi", BROADCAST_ROWS).dropDuplicates(["key"])
        read = _once(_read(texts), F.size("words").alias("n_words"))
        at = _windows(read, [self.window, *self.short], "key", "n_words")
        hashes = self.owners.select("hash").distinct()
        if hashes.count() > BROADCAST_ROWS:
            at = stored(at, "windows")
        likely = lookup(at, hashes, "hash", "left_semi", BROADCAST_ROWS)
        known = self.owners.select("hash", F.col("window").alias("same")).distinct()
        hits = stored(likely.join(known, (likely["hash"] == known["hash"]) & (F.col("window") == F.col("same"))).select(
            "key", "n_words", "start", "length", likely["hash"].alias("hash"), "window"
        ), "hits")
        covered = hits.groupBy("key").agg(
            F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(F.struct("start", "length"))).alias("hits")
        )
        owners = self.owners.select(F.col("hash").alias("of"), F.col("window").alias("same"), "item_id")
        listed = (
            hits.select("key", "hash", "window").distinct()
            .join(owners, (F.col("hash") == F.col("of")) & (F.col("window") == F.col("same")))
            .select("key", F.col("item_id").cast("string").alias("item_id")).distinct()
            .groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
        )
        return covered.join(listed, "key").select("key", "n_words", _covered(F.col("hits")).alias("n_hit"), "items")


def _covered(hits: Column) -> Column:
    """Number of places that sorted (start, length) pairs cover."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda held, x: F.struct(
            (held["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(held["end"], x["start"]))).alias("n"),
            F.greatest(held["end"], x["start"] + x["length"]).alias("end"),
        ),
        lambda held: held["n"],
    )


def _is_bad(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def measure(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Words, hit words, items and verdict of every document."""
    held = Benchmark(items, window, gram)
    keyed = docs.select("doc_id", _key(F.col("text")).alias("key"), "text")
    prints = stored(held.prints(_read(keyed)), "prints")
    by_text = stored(held.found(keyed, prints).select("key", "n_hit", "items"), "hit-texts")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return lookup(prints.select("doc_id", "key", "n_words"), by_text, "key").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        _is_bad(n_hit, F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    held = Benchmark(items, window, gram)
    rows, names = set_aside(docs)
    text = F.col(f"_in{docs.columns.index('text')}")
    keyed = rows.select(_key(text).alias("key"), text.alias("text"))
    prints = stored(held.prints(_read(keyed)).select("key", "kept"), "prints")
    found = held.found(keyed, prints)
    bad = stored(found.where(_is_bad(F.col("n_hit"), F.col("n_words"))).select("key"), "hit-texts")
    return lookup(rows.withColumn("key", _key(text)), bad, "key", "left_anti").select(*names)
