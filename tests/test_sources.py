import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paperlake.operators.ingest import dedupe_batch, new_papers
from paperlake.operators.requests import normalize_requests, validate_requests
from paperlake.operators.topics import resolve_topics
from paperlake.schema import PAPERS
from paperlake.sources import (
    append_papers,
    ensure_tables,
    load_table,
    paper_rules,
    papers_from_feed,
    quarantine,
    read_feed,
    read_requests,
    vector_rules,
)

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom">
  <title>a feed has a title too</title>
{entries}
</feed>"""


def entry(id_="http://arxiv.org/abs/2301.00001v1", title="A title", summary="Some text.",
          published="2023-01-02T00:00:00Z", authors=("A. One",), categories=("cs.AI",)):
    def tag(name, value):
        return "" if value is None else f"<{name}>{value}</{name}>"

    people = "".join(f"<author><name>{a}</name></author>" for a in authors)
    terms = "".join(f'<category term="{c}" scheme="s"/>' for c in categories)
    return (
        f"<entry>{tag('id', id_)}{tag('title', title)}{tag('summary', summary)}"
        f"{tag('published', published)}{people}{terms}</entry>"
    )


def write_feed(folder, name, *entries):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(FEED.format(entries="\n".join(entries)), encoding="utf-8")
    return str(folder)


def test_feed_fields(spark, tmp_path):
    path = write_feed(
        tmp_path / "in", "ok.xml",
        entry(authors=("A. One", " B. Two "), categories=("cs.AI", "", "stat.ML")),
        entry("http://arxiv.org/abs/2", authors=(), categories=()),
    )
    rows = papers_from_feed(read_feed(spark, path)).orderBy("position").collect()
    assert [r["arxiv_id"] for r in rows] == ["2301.00001v1", "2"]
    assert rows[0]["authors"] == "A. One; B. Two" and rows[0]["categories"] == "cs.AI, stat.ML"
    assert rows[0]["published_date"] == dt.date(2023, 1, 2) and rows[0]["feed"] == "ok.xml"
    assert rows[1]["authors"] == "" and rows[1]["categories"] == ""


def test_feed_edges_do_not_lose_the_batch(spark, tmp_path):
    path = write_feed(
        tmp_path / "in", "edges.xml",
        entry("http://a/1v1", title="\n  Two\n  lines "),
        entry("http://a/2", title=None, summary=None),
        entry("http://a/3", title=""),
        entry(None),
        entry("http://a/5", published=None),
        entry("http://a/6", published="soon"),
        entry("http://arxiv.org/abs/hep-th/9901001v2"),
        entry("http://a/1v2"),
        entry("http://a/" + "9" * 51),
    )
    papers = papers_from_feed(read_feed(spark, path))
    good, bad = quarantine(papers, paper_rules())
    kept = {r["arxiv_id"]: r["title"] for r in good.collect()}
    assert kept == {
        "1v1": "Two   lines", "2": "No title", "3": "No title",
        "9901001v2": "A title", "1v2": "A title",
    }
    assert sorted(tuple(r["reasons"]) for r in bad.collect()) == [
        ("bad date",), ("bad date",), ("id too long",), ("missing id",)
    ]


def test_first_arrival_wins(spark, tmp_path):
    folder = tmp_path / "in"
    write_feed(folder, "a.xml", entry("http://a/1", title="first"), entry("http://a/1", title="second"))
    path = write_feed(folder, "b.xml", entry("http://a/1", title="third"), entry("http://a/2"))
    rows = dedupe_batch(papers_from_feed(read_feed(spark, path))).collect()
    assert {r["arxiv_id"]: r["title"] for r in rows} == {"1": "first", "2": "A title"}


@pytest.mark.parametrize("batch_rows", [1000, 0])
def test_stored_papers_are_skipped_whole(spark, batch_rows):
    stored = spark.createDataFrame([("a",), ("b",), ("b",)], "arxiv_id string")
    batch = spark.createDataFrame([("b", "new title"), ("c", "x")], "arxiv_id string, title string")
    assert [tuple(r) for r in new_papers(batch, stored, batch_rows=batch_rows).collect()] == [("c", "x")]


def test_vector_rules(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [1.0, None]), (4, [0.0, 0.0])],
        "i int, embedding array<float>",
    )
    good, bad = quarantine(rows, vector_rules(dim=2))
    assert [r["i"] for r in good.collect()] == [0]
    assert {r["i"]: r["reasons"] for r in bad.collect()} == {
        1: ["missing vector"], 2: ["wrong dimension"], 3: ["null element"], 4: ["zero vector"]
    }


REQUESTS = [
    {"request_id": "defaults", "query": "why?"},
    {"request_id": "name", "query": "why?", "topic": "Physics", "top_k": 2},
    {"request_id": "unknown", "query": "why?", "topic": "Nothing"},
    {"request_id": "all", "query": "why?", "topic": "All Topics"},
    {"request_id": "zero", "query": "why?", "topic_id": 0},
    {"request_id": "both", "query": "why?", "topic_id": 7, "topic": "Physics"},
    {"request_id": "empty", "query": "  "},
    {"request_id": "absent"},
    {"query": "who am I?"},
]


@pytest.fixture
def request_file(tmp_path):
    folder = tmp_path / "requests"
    folder.mkdir()
    lines = "\n".join(json.dumps(r) for r in REQUESTS)
    (folder / "r.json").write_text(lines)
    return str(folder)


def test_requests(spark, request_file):
    rows = normalize_requests(read_requests(spark, request_file, "chat"), "chat")
    good, bad = validate_requests(rows)
    assert {r["request_id"] for r in bad.collect()} == {"empty", "absent"}
    assert {r["status"] for r in bad.collect()} == {400}
    top_k = {r["request_id"]: r["top_k"] for r in good.collect()}
    assert top_k["defaults"] == 5 and top_k["name"] == 2
    assert len(top_k) == 7 and any(k.startswith("r.json#") for k in top_k)


@pytest.mark.parametrize("on_unknown, searchable", [("all", True), ("none", False)])
def test_topics_of_requests(spark, request_file, on_unknown, searchable):
    topics = spark.createDataFrame([(3, "Physics"), (0, "Zero")], "id long, name string")
    found = resolve_topics(read_requests(spark, request_file, "chat"), topics, on_unknown)
    got = {r["request_id"]: (r["topic_id"], r["searchable"]) for r in found.collect()}
    assert got["defaults"] == (None, True) and got["all"] == (None, True)
    assert got["name"] == (3, True) and got["zero"] == (0, True) and got["both"] == (7, True)
    assert got["unknown"] == (None, searchable)


def test_ingest_defaults(spark, tmp_path):
    folder = tmp_path / "requests"
    folder.mkdir()
    (folder / "r.json").write_text('{"request_id": "a"}\n{"request_id": "b", "query": "x-ray of 3d", "topic_name": "T"}')
    rows = normalize_requests(read_requests(spark, str(folder), "ingest"), "ingest")
    got = {r["request_id"]: (r["query"], r["max_results"], r["topic_name"]) for r in rows.collect()}
    assert got == {"a": ("machine learning", 10, "Machine Learning"), "b": ("x-ray of 3d", 10, "T")}


def test_tables_by_name(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS paperlake_test")
    try:
        papers, topics = ensure_tables(spark, "paperlake_test")
        assert ensure_tables(spark, "paperlake_test") == (papers, topics)
        row = spark.createDataFrame(
            [(1, "a", "t", "", "x", None, "", None, [1.0])],
            "id long, arxiv_id string, title string, authors string, abstract string, "
            "published_date date, categories string, topic_id long, embedding array<float>",
        )
        written = append_papers(row, papers)
        assert written.columns == PAPERS.fieldNames()
        stored = load_table(spark, papers).first()
        assert stored["arxiv_id"] == "a" and stored["created_at"] is not None
        assert load_table(spark, topics).count() == 0
    finally:
        spark.sql("DROP DATABASE paperlake_test CASCADE")


def test_absent_table_is_empty_but_other_errors_are_raised(spark, tmp_path):
    assert load_table(spark, str(tmp_path / "nothing"), PAPERS).count() == 0
    with pytest.raises(Exception):
        load_table(spark, str(tmp_path / "nothing"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        load_table(spark, str(tmp_path / "broken"), PAPERS).select(F.max("id")).collect()
