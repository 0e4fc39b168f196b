"""Pages by address and texts by noise."""

from pyspark.sql import functions as F

from paperlake.operators.noise import noise_filter, noise_shares
from paperlake.operators.values import dedupe_urls

from .base import query, table


def spelt_twice(spark, folder):
    """Pages, and each again under another spelling of its address; some without any."""
    pages = table(spark, folder, "pages")
    other = F.regexp_replace(
        F.regexp_replace("url", "^http", "HtTp"), r"\.example\.([a-z]+)/", ".Example.$1:0/./x%2f/../"
    )
    port = F.regexp_replace(other, ":0/", ":/")
    lost = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("//"), "url")).otherwise(port)
    again = pages.select((F.col("page_id") + 1_000_000).alias("page_id"), lost.alias("url"), "html")
    return again.unionByName(pages.select("page_id", "url", "html"))


@query("""
SELECT min(page_id) AS page_id, regexp_replace(url, '#.*$', '') AS url, arg_min(length(html), page_id) AS size
FROM pages GROUP BY 2""")
def deduped_urls(spark, folder):
    """One page per address, whatever its spelling."""
    kept, _ = dedupe_urls(spelt_twice(spark, folder))
    return kept.select("page_id", "url", F.char_length("html").cast("long").alias("size"))


@query("""
SELECT page_id + 1000000 AS page_id, '//' || url AS url, 'no address' AS reason FROM pages WHERE page_id % 7 = 0""")
def pages_without_address(spark, folder):
    """Pages that no address can be read of."""
    _, aside = dedupe_urls(spelt_twice(spark, folder))
    return aside.select("page_id", "url", F.array_join("reasons", ",").alias("reason"))


KINDS_SQL = r"""kinds AS (
  SELECT doc_id, source, length(t) AS chars, length(rest) AS others,
         length(regexp_replace(rest, '[^\p{P}]', '', 'g')) AS punctuation,
         length(regexp_replace(rest, '[^\p{Cc}\p{Cf}\p{Co}\x{2028}\x{2029}\x{FFFD}]', '', 'g')) AS unprintable,
         CASE WHEN strlen(t) > length(t) THEN length(regexp_replace(t, '[^\p{L}]', '', 'g')) ELSE 0 END AS letters,
         length(regexp_replace(t, '[^\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{300}-\x{36F}]', '', 'g')) AS accents
  FROM (SELECT doc_id, source, coalesce(text, '') AS t,
               regexp_replace(coalesce(text, ''), '[\p{L}\p{N}\p{M}\x20\x09\x0A\x0D.,;:!?''"()-]+', '', 'g') AS rest
        FROM documents)),
shares AS (
  SELECT *, others - punctuation - unprintable AS signs,
         CASE WHEN chars > 0 THEN (punctuation + 2 * (others - punctuation - unprintable)) / chars ELSE 0.0 END AS s,
         CASE WHEN letters >= 8 THEN accents / letters ELSE 0.0 END AS a,
         CASE WHEN chars > 0 THEN 8 * unprintable / chars ELSE 0.0 END AS u FROM kinds),
noise AS (
  SELECT *, CASE WHEN s >= 0.3 THEN s ELSE 0.0 END + CASE WHEN a >= 0.35 THEN a ELSE 0.0 END + u AS noise FROM shares)"""


@query(rf"""
WITH {KINDS_SQL},
sums AS (
  SELECT source, count(*) AS texts, CAST(count(*) FILTER (noise >= 0.2) AS BIGINT) AS noisy, CAST(sum(chars) AS BIGINT) AS chars,
         sum(punctuation + 2 * signs) / sum(chars) AS s,
         CASE WHEN sum(letters) >= 8 THEN sum(accents) / sum(letters) ELSE 0.0 END AS a, 8 * sum(unprintable) / sum(chars) AS u
  FROM noise GROUP BY source)
SELECT source, texts, noisy, chars, round(s, 9) AS sign_share, round(a, 9) AS accent_share, round(u, 9) AS unprintable_share,
       round(CASE WHEN s >= 0.3 THEN s ELSE 0.0 END + CASE WHEN a >= 0.35 THEN a ELSE 0.0 END + u, 9) AS noise
FROM sums""")
def noise_by_source(spark, folder):
    """Kinds of characters in the texts of each source."""
    found = noise_shares(table(spark, folder, "documents"))
    shares = ["sign_share", "accent_share", "unprintable_share", "noise"]
    return found.select("source", "texts", "noisy", "chars", *[F.round(name, 9).alias(name) for name in shares])


@query(rf"""
WITH {KINDS_SQL}
SELECT doc_id, round(s, 9) AS sign_share, round(a, 9) AS accent_share, round(u, 9) AS unprintable_share, round(noise, 9) AS noise
FROM noise WHERE noise >= 0.02""")
def noisy_texts(spark, folder):
    """Texts set aside for noise, with a threshold that some of the given ones reach."""
    _, aside = noise_filter(table(spark, folder, "documents"), 0.02)
    shares = ["sign_share", "accent_share", "unprintable_share", "noise"]
    return aside.select("doc_id", *[F.round(name, 9).alias(name) for name in shares])
