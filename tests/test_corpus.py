"""Addresses in one form, one page for each, and noise of texts."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from paperlake.operators.noise import noise_filter, noise_shares, with_noise
from paperlake.operators.values import canonical_url, dedupe_urls, first_per_key

from .conftest import plan_of


@pytest.mark.parametrize(
    "url, plain",
    [
        ("http://e.com/%7euser/%c3%a9?q=%2f#f", "http://e.com/%7Euser/%C3%A9?q=%2F"),
        ("http://e.com/é x|y", "http://e.com/%C3%A9%20x%7Cy"),
        ("http://e.com/100%/%41", "http://e.com/100%25/%2541"),
        ("http://e.com/a%2", "http://e.com/a%252"),
        ("http://e.com/a?b=c d&e=<f>", "http://e.com/a?b=c%20d&e=%3Cf%3E"),
        ("http://e.com?", "http://e.com/?"),
        ("http://e.com/a?x?y/z", "http://e.com/a?x?y/z"),
        ("http://E.com:0080/", "http://e.com:80/"),
        ("http://e.com:/x", "http://e.com/x"),
        ("http://e.com:65536/", None),
        ("http://u ser@E.com/", "http://u%20ser@e.com/"),
        ("http://[::1]:8080/a", "http://[::1]:8080/a"),
        ("http://[::FF%25eth0]/a", "http://[::ff%25eth0]/a"),
        ("http://e com/", None),
        ("//e.com/", None),
        ("mailto:a@b.c", None),
        ("", None),
        ("http:///x", None),
    ],
)
def test_spelling_of_addresses(spark, url, plain):
    rows = spark.createDataFrame([(url,)], "u string")
    found = rows.select(canonical_url(F.col("u")).alias("c"))
    assert found.first()[0] == plain
    if plain:
        assert found.select(canonical_url(F.col("c"))).first()[0] == plain


def test_one_page_per_address(spark):
    """A third of the pages has one address; of equal ids the first by all columns stays; none is lost."""
    rows = [(i, f"HTTP://Hot.com/{'./' * (i % 3)}", f"h{i}") for i in range(300, 0, -1)]
    rows += [(i, f"http://e{i % 50}.com/#{i}", "x") for i in range(1000, 1500)]
    rows += [(7, "http://twice.com", "b"), (7, "http://twice.com/", "a"), (None, "http://e0.com", "n"), (5, None, "n"), (6, "no", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    kept, bad = dedupe_urls(pages)
    found = {r.url: (r.page_id, r.html) for r in kept.collect()}
    assert found["http://hot.com/"] == (1, "h1") and found["http://twice.com/"] == (7, "a")
    assert len(found) == 52 and kept.count() == 52 and kept.columns == pages.columns
    assert sorted((r.page_id, r.reasons) for r in bad.collect()) == [(5, ["no address"]), (6, ["no address"])]
    assert "Window" not in plan_of(kept)
    empty, none = dedupe_urls(pages.limit(0))
    assert empty.count() == none.count() == 0


def test_first_per_key_has_nulls_last(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("b", None, 3), (None, 1, 4)], "k string, o int, v int")
    assert sorted(map(tuple, first_per_key(rows, "k", ["o"]).collect())) == [("a", 5, 2), ("b", None, 3)]


def counted(text):
    """Shares and noise character by character."""
    text = text or ""
    plain = set(" \t\n\r.,;:!?'\"()-")
    kinds = [unicodedata.category(c) for c in text]
    rest = [(c, k) for c, k in zip(text, kinds) if k[0] not in "LNM" and c not in plain]
    punctuation = sum(k[0] == "P" for _, k in rest)
    unprintable = sum(k in ("Cc", "Cf", "Co") or c in "  �" for c, k in rest)
    letters = sum(k[0] == "L" for k in kinds)
    accents = sum(0xC0 <= ord(c) <= 0x24F and ord(c) not in (0xD7, 0xF7) or 0x300 <= ord(c) <= 0x36F for c in text)
    n = max(1, len(text))
    s = (punctuation + 2 * (len(rest) - punctuation - unprintable)) / n
    a = accents / letters if letters >= 8 and not text.isascii() else 0.0
    u = 8 * unprintable / n
    return s, a, u, (s if s >= 0.3 else 0) + (a if a >= 0.35 else 0) + u


TEXTS = [
    "plain words, and no more.", "", None, "ÀÉÎÕÜ àéîõü ÿ", "{}[]<>~~^^||", "€€€ $$$ +++ 漢字 ☃☃☃", "a\x00b\x07c​d�", "é",
    "été né là", "  ", "日本語のテキスト。", "é" * 20, "x" * 50 + "#" * 20, "😀 ok 😀", "a\tb\nc\rd\x0be",
]


def test_noise_of_texts(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r.doc_id: (r.sign_share, r.accent_share, r.unprintable_share, r.noise) for r in with_noise(rows).collect()}
    for i, text in enumerate(TEXTS):
        assert found[i] == pytest.approx(counted(text)), text
    kept, aside = noise_filter(rows)
    noisy = {i for i, text in enumerate(TEXTS) if counted(text)[3] >= 0.2}
    assert {r.doc_id for r in aside.collect()} == noisy and {r.doc_id for r in kept.collect()} == set(range(len(TEXTS))) - noisy
    assert kept.columns == rows.columns and noise_filter(rows.limit(0))[0].count() == 0


def test_noise_of_a_very_long_text(spark):
    rows = spark.range(2).select(F.col("id").alias("doc_id"), F.repeat(F.lit("words é ☃{"), 1_000_000).alias("text"))
    for row in with_noise(rows).collect():
        assert row.kinds.chars == 10_000_000 and row.kinds.accents == 1_000_000
        assert row.kinds.punctuation == row.kinds.signs == 1_000_000 and row.kinds.unprintable == 0


def test_shares_of_groups(spark):
    rows = spark.createDataFrame(
        [("a", "ok"), ("a", "{{{{{{"), ("b", None), (None, "€€"), ("b", "")], "source string, text string"
    )
    found = {r.source: (r.texts, r.noisy, r.chars, r.sign_share, r.noise) for r in noise_shares(rows).collect()}
    assert found == {"a": (2, 1, 8, 0.75, 0.75), "b": (2, 0, 0, 0.0, 0.0), None: (1, 1, 2, 2.0, 2.0)}
