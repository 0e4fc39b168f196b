"""Noise of texts: the shares of signs, accents and unprintable characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a clean text is made of, and kinds among the rest.
PLAIN = r"[\p{L}\p{N}\p{M}\x20\x09\x0A\x0D.,;:!?'\"()-]+"
PUNCTUATION = r"\p{P}"
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Co}\x{2028}\x{2029}\x{FFFD}]"
ACCENTED = r"[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{300}-\x{36F}]"
NO_LETTER = r"[^\p{L}]+"

# A share below its least counts as none; weights of a sign that
# is no punctuation and of an unprintable character; letters below which accents
# say nothing; the noise from which on a text is noisy.
LEAST_SIGNS, LEAST_ACCENTS, LEAST_LETTERS = 0.3, 0.35, 8
SIGN_WEIGHT, UNPRINTABLE_WEIGHT = 2, 8
THRESHOLD = 0.2

COUNTS = ("chars", "letters", "accents", "punctuation", "signs", "unprintable")


def noise_counts(text: Column) -> list[Column]:
    """Characters by kind, in the order of ``COUNTS``; a null text has none.

    One pass over the text leaves what is not plain, mostly nothing, and the
    kinds are counted there. Letters and accents are counted only in texts with
    characters beyond ASCII.
    """
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    rest = F.regexp_replace(text, PLAIN, "")
    beyond = F.octet_length(text) > chars
    punctuation = F.regexp_count(rest, F.lit(PUNCTUATION))
    unprintable = F.regexp_count(rest, F.lit(UNPRINTABLE))
    accents = F.when(beyond, F.regexp_count(text, F.lit(ACCENTED))).otherwise(0)
    letters = F.when(beyond, F.char_length(F.regexp_replace(text, NO_LETTER, ""))).otherwise(0)
    signs = F.char_length(rest) - punctuation - unprintable
    return [
        count.cast("long").alias(name)
        for name, count in zip(COUNTS, (chars, letters, accents, punctuation, signs, unprintable))
    ]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def noise_of(counts: str) -> list[Column]:
    """sign_share, accent_share, unprintable_share and noise from a struct of counts."""
    c = {name: F.col(f"{counts}.{name}") for name in COUNTS}
    signs = _share(c["punctuation"] + SIGN_WEIGHT * c["signs"], c["chars"])
    accents = F.when(c["letters"] >= LEAST_LETTERS, _share(c["accents"], c["letters"])).otherwise(F.lit(0.0))
    unprintable = _share(UNPRINTABLE_WEIGHT * c["unprintable"], c["chars"])
    above = lambda share, least: F.when(share >= least, share).otherwise(F.lit(0.0))
    noise = above(signs, LEAST_SIGNS) + above(accents, LEAST_ACCENTS) + unprintable
    return [
        signs.alias("sign_share"), accents.alias("accent_share"), unprintable.alias("unprintable_share"), noise.alias("noise")
    ]


def with_noise(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the counts as a struct ``kinds``, the three shares and the noise.

    Null and empty texts have no noise.
    """
    counted = docs.select("*", F.inline(F.array(F.struct(F.struct(*noise_counts(F.col(text))).alias("kinds")))))
    return counted.select("*", *noise_of("kinds"))


def noise_filter(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts with less noise than ``threshold``, and the others, which keep their shares."""
    judged = with_noise(docs, text)
    kept = judged.where(F.col("noise") < threshold).select(*docs.columns)
    return kept, judged.where(F.col("noise") >= threshold)


def noise_shares(docs: DataFrame, group: str = "source", threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """For each group: texts, noisy ones, characters, and the shares of its texts taken together.

    Sums are made in each task before rows move, so a hot group is cheap.
    """
    judged = with_noise(docs.select(group, text), text)
    sums = [F.sum(F.col(f"kinds.{name}")).alias(name) for name in COUNTS]
    total = judged.groupBy(group).agg(
        F.count("*").alias("texts"), F.count_if(F.col("noise") >= threshold).alias("noisy"), *sums
    )
    of_all = total.select(group, "texts", "noisy", "chars", F.struct(*COUNTS).alias("kinds"))
    return of_all.select(group, "texts", "noisy", "chars", *noise_of("kinds"))
