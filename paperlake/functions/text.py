"""Text columns of papers and requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space when a field is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: where the abstract page of a paper lives.
PAPER_PAGE = "https://arxiv.org/abs/"

# Letters with a case, the ones that make up a word for title case.
_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"


def strip(col: Column) -> Column:
    """Remove white space from both ends."""
    return F.trim(col, F.lit(WHITE_SPACE))


def clean_text(col: Column) -> Column:
    """Strip, then turn each newline into one space; runs of spaces stay."""
    return F.translate(strip(col), "\n", " ")


def paper_id(col: Column) -> Column:
    """What follows the last ``/`` of an id URL, version suffix included."""
    return F.element_at(F.split(col, "/"), -1)


def base_id(col: Column) -> Column:
    """The paper id without its version suffix."""
    return F.regexp_replace(paper_id(col), r"v\d+$", "")


def join_authors(col: Column) -> Column:
    """Names of an ``array<struct<name>>`` as one text; absent names are left out."""
    names = F.array_compact(F.transform(col, lambda a: strip(a["name"])))
    return F.coalesce(F.array_join(names, "; "), F.lit(""))


def join_categories(col: Column) -> Column:
    """Terms of an ``array<struct<_term>>`` as one text; empty terms are left out."""
    terms = F.filter(F.transform(col, lambda c: c["_term"]), lambda t: F.length(t) > 0)
    return F.coalesce(F.array_join(terms, ", "), F.lit(""))


def published_date(col: Column) -> Column:
    """Date in the first ten characters of a timestamp text, else null."""
    return F.try_to_date(F.substring(col, 1, 10), "yyyy-MM-dd")


def embed_text(title: Column, abstract: Column) -> Column:
    """The text a paper is embedded by: title, blank line, abstract."""
    return F.concat(title, F.lit("\n\n"), abstract)


def paper_url(col: Column) -> Column:
    """Address of the abstract page of a paper id."""
    return F.concat(F.lit(PAPER_PAGE), col)


def title_case(col: Column) -> Column:
    """First cased letter after each uncased character in upper case, others lower.

    Differs from ``initcap``, which only looks at spaces: ``x-ray`` gives
    ``X-Ray``. So it is given each run of cased letters by itself.
    """
    pieces = F.regexp_extract_all(col, F.lit(f"[{_CASED}]+|[^{_CASED}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, F.initcap), "")


def similarity_pct(distance: Column) -> Column:
    """Similarity of a cosine distance, to 3 places, as a percentage text."""
    return F.format_string("%.1f%%", F.lit(100.0) * F.round(F.lit(1.0) - distance, 3))
