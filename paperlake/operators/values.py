"""Columns of mixed dates and of addresses brought to one form, and one page per address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.quarantine import quarantine

# What stands in each part of an address as it is; all else is escaped.
USER_CHARS = r"A-Za-z0-9._~\-!$&'()*+,;=:"
PATH_CHARS = USER_CHARS + "@/"
QUERY_CHARS = PATH_CHARS + "?"
# The parts of an address, and a host with an optional port.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^\\/?#]*))?([^?#]*)(?:\?([^#]*))?"
HOST_PORT = r"^(\[[0-9A-Fa-f:.]+(?:%[^\]]*)?\]|(?:[^\x00-\x20\[\]%:/?#@]|%[0-9A-Fa-f]{2})+)(?::0*([0-9]{0,5}))?$"
LAST_PORT = 65535


def normalize_dates(
    df: DataFrame, col: str, formats: list[str], out: str = "parsed"
) -> tuple[DataFrame, DataFrame]:
    """Read a date text by the first format that fits; rows none fits are set aside."""
    text = F.trim(col)
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
    return quarantine(df.withColumn(out, parsed), {"unread date": F.col(out).isNull()})


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    # a path that ends in a dot segment names a folder
    folder = path.rlike(r"/\.\.?$") & ~joined.endswith("/")
    return F.when(folder, F.concat(joined, F.lit("/"))).otherwise(joined)


def escaped(part: Column, kept: str) -> Column:
    """One spelling of the escapes of a part of an address; ``kept`` are the characters it may hold.

    Escapes get capital digits, and other characters are escaped byte by byte. A
    part in which some percent sign begins no escape has none: all are escaped.
    """
    pieces = F.split(part, "%")
    upper = F.transform(
        pieces,
        lambda x, i: F.when(i == 0, x).otherwise(
            F.concat(F.upper(F.substring(x, 1, 2)), F.substr(x, F.lit(3)))
        ),
    )
    is_escaped = F.forall(
        F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: x.rlike("^[0-9A-Fa-f]{2}")
    )
    shown = F.when(
        part.contains("%"),
        F.when(is_escaped, F.array_join(upper, "%")).otherwise(F.replace(part, F.lit("%"), F.lit("%25"))),
    ).otherwise(part)
    outside = rf"[^{kept}%]"
    each = F.transform(
        F.split(shown, ""),
        lambda c: F.when(
            c.rlike(outside), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
        ).otherwise(c),
    )
    return F.when(shown.rlike(outside), F.array_join(each, "")).otherwise(shown)


def canonical_url(url: Column) -> Column:
    """One spelling per address: lower-case scheme and host, port without zeros,
    dot segments resolved, an empty path written ``/``, escapes in one form, no
    fragment. Null for a text that is no address: without scheme or host, or
    with a host or port that cannot be.
    """
    plain = F.trim(url)
    scheme, authority, path, query = (F.regexp_extract(plain, PARTS, i) for i in (1, 2, 3, 4))
    has_query = F.regexp_replace(plain, "#(?s:.*)$", "").contains("?")
    user = F.regexp_extract(authority, "^(.*)@", 1)
    place = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.regexp_extract(place, HOST_PORT, 1))
    port = F.regexp_extract(place, HOST_PORT, 2)
    whole = escaped(_without_dots(path), PATH_CHARS)
    fits = (scheme != "") & (host != "") & (F.coalesce(F.nullif(port, F.lit("")).cast("int"), F.lit(0)) <= LAST_PORT)
    address = F.concat(
        F.lower(scheme),
        F.lit("://"),
        F.when(authority.contains("@"), F.concat(escaped(user, USER_CHARS), F.lit("@"))).otherwise(""),
        host,
        F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""),
        F.when(whole == "", F.lit("/")).otherwise(whole),
        F.when(has_query, F.concat(F.lit("?"), escaped(query, QUERY_CHARS))).otherwise(""),
    )
    return F.when(fits, address)


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, then by all columns; nulls are last.

    The winner is a minimum, so every task keeps one row of a key before rows
    move, however many share it. Rows with a null key are all kept out.
    """
    ranked = [F.struct(F.col(name).isNull().alias("no"), F.col(name).alias("at")).alias(f"o{i}") for i, name in enumerate(order)]
    least = F.min(F.struct(*ranked, F.struct(*df.columns).alias("row"))).alias("least")
    found = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(least)
    return found.select("least.row.*")


def dedupe_urls(
    pages: DataFrame, url: str = "url", order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """One page per address, its address in canonical form; and the rows without an address, set aside.

    Of the pages of one address the first by ``order`` (``page_id``) stays.
    """
    named = pages.withColumn("_address", canonical_url(F.col(url)))
    good, bad = quarantine(named, {"no address": F.col("_address").isNull()})
    kept = first_per_key(good.withColumn(url, F.col("_address")).drop("_address"), url, order or ["page_id"])
    return kept, bad.drop("_address")
