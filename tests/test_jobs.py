import importlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalogue import QUERIES
from catalogue.models import counting_completer, failing_hash_model, hash_model
from paperlake.functions import hash_embedding
from paperlake.operators import answer as an
from paperlake.operators.embed import embed, embed_only
from paperlake.operators.scratch import ROW, in_slices, with_row, write_parts
from paperlake.plans import chat, ingest
from paperlake.schema import PAPERS, TOPICS
from paperlake.session import shared_folder
from paperlake.sources import append_papers, append_topics, load_table, read_feed
from paperlake.streaming import chat_stream, ingest_stream

from .conftest import plan_of
from .test_sources import entry, write_feed

DIM = 16
# Their names in the packages are those of the functions.
ingesting = importlib.import_module("paperlake.plans.ingest")
streaming_jobs = importlib.import_module("paperlake.streaming.jobs")


def feed_requests(spark, *rows):
    layout = "request_id string, query string, max_results int, topic_name string, feed string"
    return spark.createDataFrame(list(rows), layout)


@pytest.fixture
def feeds(tmp_path):
    folder = tmp_path / "feeds"
    write_feed(
        folder, "a.xml",
        entry("http://a/1", title="one two"), entry("http://a/2", published="soon"),
        entry("http://a/3", summary="three four"), entry("http://a/1", title="again"),
        entry("http://a/4", summary="the mark"),
    )
    return write_feed(
        folder, "b.xml", entry("http://a/3", title="other"), entry("http://a/5"), entry("http://a/6")
    )


def run(spark, feeds, tmp_path, requests, model=failing_hash_model):
    papers, topics = str(tmp_path / "papers"), str(tmp_path / "topics")
    result = ingest(requests, read_feed(spark, feeds), papers, topics, lambda: model(DIM), DIM)
    return result, papers, topics


def test_ingest_twice(spark, feeds, tmp_path):
    requests = feed_requests(
        spark,
        ("r1", "deep nets", None, None, "a.xml"),
        ("r2", "x-ray", 2, "Rays", "b.xml"),
        ("r3", "nothing", None, None, "absent.xml"),
        ("r4", "long", None, "n" * 256, "b.xml"),
    )
    result, papers, topics = run(spark, feeds, tmp_path, requests)
    stored = load_table(spark, papers, PAPERS).collect()
    assert {r["arxiv_id"]: r["title"] for r in stored} == {"1": "one two", "3": "A title", "5": "A title"}
    assert sorted(r["id"] for r in stored) == [1, 2, 3]
    assert all(len(r["embedding"]) == DIM and r["created_at"] for r in stored)
    names = {r["id"]: r["name"] for r in load_table(spark, topics, TOPICS).collect()}
    assert sorted(names.values()) == ["Deep Nets", "Rays"]
    assert {r["arxiv_id"]: names[r["topic_id"]] for r in stored} == {
        "1": "Deep Nets", "3": "Deep Nets", "5": "Rays"
    }
    by_request = {r["request_id"]: r for r in result.responses.collect()}
    first = by_request["r1"]
    assert (first["status"], first["message"]) == (200, "Successfully processed 2 papers")
    assert (first["total_papers_fetched"], first["skipped"], first["failed"]) == (5, 1, 2)
    assert [tuple(f) for f in first["failures"]] == [("bad date", 1), ("cannot embed this text", 1)]
    assert [p["arxiv_id"] for p in first["papers"]] == ["1", "2", "3", "1", "4"]
    second = by_request["r2"]
    assert (second["processed_count"], second["skipped"], second["total_papers_fetched"]) == (1, 1, 2)
    assert (by_request["r3"]["status"], by_request["r3"]["message"]) == (404, "No papers found")
    assert (by_request["r4"]["status"], by_request["r4"]["message"]) == (500, "name too long")
    assert {r["arxiv_id"] for r in result.rejected.collect()} == {"2", "4"}

    again, _, _ = run(spark, feeds, tmp_path, requests)
    assert again.written.count() == 0 and load_table(spark, papers, PAPERS).count() == 3
    assert load_table(spark, topics, TOPICS).count() == 2

    more = feed_requests(spark, ("r5", "x-ray", None, "Rays", "b.xml"))
    grown, _, _ = run(spark, feeds, tmp_path, more)
    assert [(r["arxiv_id"], r["id"]) for r in grown.written.collect()] == [("6", 4)]


def test_the_model_sees_only_new_papers(spark, feeds, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted():
        plain = hash_model(DIM)

        def vectors(texts):
            seen.add(len(texts))
            return plain(texts)

        return vectors

    requests = feed_requests(spark, ("r1", "q", None, None, "a.xml"), ("r2", "q", None, None, "b.xml"))
    papers, topics = str(tmp_path / "papers"), str(tmp_path / "topics")
    for _ in range(2):
        ingest(requests, read_feed(spark, feeds), papers, topics, counted, DIM)
    assert seen.value == 5


def test_a_bad_text_does_not_cost_the_others_their_vectors(spark):
    texts = [("a",), ("the",), (None,), ("b c",)]
    rows = spark.createDataFrame(texts, "s string").coalesce(1)
    got = {r["s"]: r for r in embed(rows, "s", lambda: failing_hash_model(DIM), DIM).collect()}
    assert got["the"]["embedding"] is None and got["the"]["embed_error"] == "cannot embed this text"
    assert got["a"]["embed_error"] is None and len(got["b c"]["embedding"]) == DIM
    assert got[None]["embedding"] is None and got[None]["embed_error"] is None
    wrong = embed(rows.where("s = 'a'"), "s", lambda: hash_model(DIM), DIM + 1).first()
    assert wrong["embedding"] is None and "instead of" in wrong["embed_error"]


def test_embed_only(spark):
    rows = spark.createDataFrame(
        [("r", "f", i, f"title {i}" + " x" * 30, "the" if i == 1 else "ok", "", str(i), None) for i in range(6)],
        "request_id string, feed string, position long, title string, abstract string, "
        "authors string, arxiv_id string, published_date date",
    )
    got = embed_only(rows, lambda: failing_hash_model(DIM), 3, DIM).first()
    assert (got["total_papers_fetched"], got["embeddings_generated"]) == (6, 2)
    title = "title 1" + " x" * 30
    assert got["embedding_errors"] == [f"Embedding failed for {title[:30]}...: cannot embed this text"]
    assert [p["arxiv_id"] for p in got["sample_papers"]] == ["0", "1", "2"]


@pytest.fixture
def library(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "a", "Cats", "cats purr and sleep", 1), (2, "b", "Dogs", "dogs bark and sleep", 1),
         (3, "c", "Stars", "stars shine", 2), (4, "d", "Empty", "", 2)],
        "id long, arxiv_id string, title string, abstract string, topic_id long",
    ).withColumn("embedding", hash_embedding(F.col("abstract"), DIM))
    topics = spark.createDataFrame([(1, "Animals"), (2, "Space"), (3, "Void")], "id long, name string")
    return rows, topics


CHAT = "request_id string, query string, topic_id long, topic string, top_k int"


def ask(spark, library, *rows, **options):
    requests = spark.createDataFrame(list(rows), CHAT)
    found = chat(requests, *library, lambda: failing_hash_model(DIM), counting_completer, DIM, **options)
    return {r["qid"]: r for r in found.collect()}


def test_chat(spark, library):
    got = ask(
        spark, library,
        ("plain", "cats purr", None, None, None),
        ("one", "cats purr", None, "Space", 1),
        ("void", "cats purr", None, "Void", None),
        ("empty", " ", None, None, None),
        ("broken", "the end", None, None, None),
        ("fails", "fail", None, None, 2),
        ("unknown", "cats purr", None, "Nowhere", 1),
    )
    assert got["plain"]["context_chunks"] == 3
    assert got["plain"]["sources"][0]["arxiv_id"] == "a"
    assert got["plain"]["sources"][0]["url"] == "https://arxiv.org/abs/a"
    similar = [s["similarity"] for s in got["plain"]["sources"]]
    assert similar == sorted(similar, reverse=True)
    assert [s["arxiv_id"] for s in got["one"]["sources"]] == ["c"]
    nothing = "I could not find relevant information to answer your query."
    assert (got["void"]["status"], got["void"]["response"], got["void"]["sources"]) == (200, nothing, [])
    assert (got["empty"]["status"], got["empty"]["response"]) == (400, "Query is required")
    assert (got["broken"]["status"], got["broken"]["response"]) == (500, "cannot embed this text")
    assert (got["fails"]["status"], got["fails"]["response"]) == (200, "Error details: no model")
    assert [s["arxiv_id"] for s in got["unknown"]["sources"]] == ["a"]


def test_an_unknown_topic_may_find_nothing(spark, library):
    row = ("unknown", "cats purr", None, "Nowhere", 1)
    assert ask(spark, library, row, on_unknown="none")["unknown"]["context_chunks"] == 0


def test_context_and_prompt(spark):
    hits = spark.createDataFrame(
        [(1, 2, "B", "b", "second"), (1, 1, "A", "a", "first %s")],
        "qid long, rk int, title string, arxiv_id string, content string",
    ).withColumn("similarity", F.lit(0.5))
    context = "[Source 1: A (arXiv:a)]\nfirst %s\n\n[Source 2: B (arXiv:b)]\nsecond\n"
    contexts = an.build_context(hits)
    assert contexts.first()["context"] == context
    questions = spark.createDataFrame([(1, "100% why?"), (2, "no hits")], "qid long, query string")
    row = an.build_prompts(questions, contexts).collect()
    assert len(row) == 1
    assert row[0]["prompt"] == (
        "Based on the following research paper excerpts, please answer this question: 100% why?\n\n"
        f"Research Context:\n{context}\n\n"
        "Please provide a comprehensive answer based on the information in these sources."
    )
    assert [tuple(m) for m in row[0]["messages"]] == [("user", row[0]["prompt"])]
    counts = {r["qid"]: r["context_chunks"] for r in an.hit_counts(questions, hits).collect()}
    assert counts == {1: 2, 2: 0}


def test_ingest_stream_restarts(spark, feeds, tmp_path):
    requests = feed_requests(
        spark, *((f, "q", None, f.upper(), f) for f in ("a.xml", "b.xml", "c.xml"))
    )
    papers, topics, state = (str(tmp_path / x) for x in ("papers", "topics", "state"))

    def stream(state_path):
        ingest_stream(
            spark, feeds, requests, papers, topics, state_path, lambda: hash_model(DIM), DIM,
            files_per_batch=1,
        ).awaitTermination()
        return {r["arxiv_id"] for r in load_table(spark, papers, PAPERS).collect()}

    assert stream(state) == {"1", "3", "4", "5", "6"}
    write_feed(tmp_path / "feeds", "c.xml", entry("http://a/7"), entry("http://a/1"))
    assert stream(state) == {"1", "3", "4", "5", "6", "7"}
    # a stream that has lost its state reads all files again and adds nothing
    stream(str(tmp_path / "other"))
    stored = load_table(spark, papers, PAPERS)
    assert stored.count() == 6 and stored.select("id").distinct().count() == 6


@pytest.mark.parametrize("at", ["append_papers", "write_responses"])
def test_a_failed_batch_is_repeated_with_the_same_account(spark, feeds, tmp_path, monkeypatch, at):
    """A failure before or after papers are stored: the repeat reports what the first run would have."""
    asked = feed_requests(spark, *((f, "q", None, f.upper(), f) for f in ("a.xml", "b.xml", "c.xml")))

    def stream(name):
        ingest_stream(
            spark, feeds, asked, str(tmp_path / name / "p"), str(tmp_path / name / "t"), str(tmp_path / name / "state"),
            lambda: hash_model(DIM), DIM,
        ).awaitTermination()

    def account(name):
        rows = spark.read.json(str(tmp_path / name / "state-account" / "responses"))
        return sorted((r["request_id"], r["status"], r["processed_count"], r["skipped"]) for r in rows.collect())

    stream("whole")
    module = {"append_papers": ingesting, "write_responses": streaming_jobs}[at]
    real, calls = getattr(module, at), []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("planted")
        return real(*args, **kwargs)

    monkeypatch.setattr(module, at, failing)
    with pytest.raises(Exception, match="planted"):
        stream("broken")
    stream("broken")
    assert account("broken") == account("whole") and sum(row[2] for row in account("whole")) > 0
    ids = [{(r["arxiv_id"]) for r in load_table(spark, str(tmp_path / n / "p"), PAPERS).collect()} for n in ("whole", "broken")]
    assert ids[0] == ids[1] and load_table(spark, str(tmp_path / "broken" / "p"), PAPERS).count() == len(ids[1])


def test_a_journal_of_other_input_is_written_anew(spark, feeds, tmp_path):
    stored, topics, journal = (str(tmp_path / x) for x in ("p", "t", "journal"))
    for feed, processed in (("a.xml", None), ("b.xml", None), ("b.xml", None)):
        asked = feed_requests(spark, ("r", "q", None, None, feed))
        entries = read_feed(spark, f"{feeds}/{feed}")
        result = ingesting.ingest(asked, entries, stored, topics, lambda: hash_model(DIM), DIM, journal=journal)
        mine = {r["arxiv_id"] for r in result.written.collect()}
        kept = {r["arxiv_id"] for r in load_table(spark, stored, PAPERS).collect()}
        assert mine and mine <= kept
        assert result.responses.first()["processed_count"] == len(mine)


def test_chat_stream(spark, library, tmp_path):
    rows, topics = library
    papers, names, asked, out, state = (
        str(tmp_path / x) for x in ("papers", "topics", "asked", "out", "state")
    )
    for extra in ("authors", "categories"):
        rows = rows.withColumn(extra, F.lit(""))
    append_papers(rows.withColumn("published_date", F.lit(None).cast("date")), papers)
    append_topics(topics.withColumn("description", F.lit("")), names)
    (tmp_path / "asked").mkdir()

    def put(name, *requests):
        (tmp_path / "asked" / name).write_text("\n".join(json.dumps(r) for r in requests))
        chat_stream(
            spark, asked, papers, names, out, state, lambda: hash_model(DIM), counting_completer, DIM
        ).awaitTermination()
        return {r["qid"]: r for r in spark.read.json(out).collect()}

    first = put("1.json", {"request_id": "x", "query": "dogs bark", "top_k": 1})
    assert first["x"]["sources"][0]["arxiv_id"] == "b"
    second = put("2.json", {"query": "stars", "topic": "Space", "top_k": 1}, {"request_id": "y"})
    assert len(second) == 3 and second["y"]["status"] == 400


def test_stream_counts_entries_of_all_files(spark, feeds, tmp_path):
    asked = feed_requests(spark, ("r1", "deep nets", 2, None, "a.xml"), ("r1", "deep nets", 2, None, "b.xml"))
    for state in ("state", "lost"):
        ingest_stream(
            spark, feeds, asked, str(tmp_path / "p"), str(tmp_path / "t"), str(tmp_path / state),
            lambda: hash_model(DIM), DIM, files_per_batch=1, account_path=str(tmp_path / "account"),
        ).awaitTermination()
        account = spark.read.json(str(tmp_path / "account" / "responses"))
        assert account.where("request_id = 'r1'").agg({"total_papers_fetched": "sum"}).first()[0] == 2
    assert load_table(spark, str(tmp_path / "p"), PAPERS).count() <= 2


def test_embedding_holds_the_numbers_of_one_call(spark):
    """A batch of 8,000 vectors of 512 numbers is not gathered as Python numbers, some 130 MB."""
    def load():
        import os

        def resident():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

        return lambda texts: [[resident(), *(float(i + len(t)) for i in range(511))] for t in texts]

    texts = spark.range(0, 8000, 1, 1).select(F.col("id").cast("string").alias("text"))
    seen = embed(texts, "text", load, 512).agg(F.min(F.col("embedding")[0]), F.max(F.col("embedding")[0])).first()
    assert seen[1] - seen[0] < 60, seen


def test_embedding_keeps_nulls_errors_and_what_is_no_number(spark):
    def load():
        def model(texts):
            if "bad" in texts:
                raise ValueError("cannot")
            return [[float("nan"), 1e300] if t == "odd" else [1.0, 2.0] if t != "long" else [1.0] for t in texts]

        return model

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, "bad", "odd", "long", ""])], "i int, t string")
    got = {r["i"]: (r["embedding"], r["embed_error"]) for r in embed(rows.coalesce(1), "t", load, 2).collect()}
    assert got[0] == ([1.0, 2.0], None) and got[1] == (None, None) and got[2] == (None, "cannot")
    assert got[3] == ([None, float("inf")], None) and got[4] == (None, "1 numbers instead of 2") and got[5] == got[0]


def size_of(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


@pytest.fixture
def long_documents(spark, tmp_path):
    """600 documents of 16 kB that compress to half of that, and the bytes of their texts."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(240)), lambda i: F.sha2(F.concat_ws("-", "id", i.cast("string")), 256)), " ")
    docs = spark.range(0, 600, 1, 3).select(
        F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source")
    )
    docs.write.parquet(str(tmp_path / "in" / "documents.parquet"))
    return str(tmp_path / "in"), 600 * (240 * 65 - 1)


def disk_of(spark, query, folder):
    """Rows of a query, what it left in the shared folder, and what its shuffles wrote, in bytes."""
    shared = shared_folder(spark).removeprefix("file:")
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    local = [str(d) for d in manager.localDirsString()]
    kept, shuffled = size_of(shared), sum(size_of(d) for d in local)
    rows = QUERIES[query](spark, folder).count()
    return rows, size_of(shared) - kept, sum(size_of(d) for d in local) - shuffled


def test_a_stream_keeps_its_texts_three_times(spark, long_documents):
    """The feed, the papers and the journal, all compressed; shuffles and scratch files hold keys."""
    folder, texts = long_documents
    rows, kept, shuffled = disk_of(spark, "streamed_papers", folder)
    assert rows == 600 and kept < 2.6 * texts and shuffled < 0.2 * texts, (kept / texts, shuffled / texts)


def test_ingesting_twice_keeps_its_texts_twice(spark, long_documents):
    """The feed and the papers; what the runs kept for themselves is gone, and shuffles hold keys."""
    folder, texts = long_documents
    rows, kept, shuffled = disk_of(spark, "ingested_papers", folder)
    assert rows == 600 and kept < 1.9 * texts and shuffled < 0.2 * texts, (kept / texts, shuffled / texts)


@pytest.mark.parametrize("most", [1000, 70, 9])
def test_kept_rows_are_met_in_slices_without_a_shuffle(spark, tmp_path, most):
    """Slices hold all rows that are named, once for each name, also where one task wrote more than fit a slice."""
    write_parts(path := str(tmp_path / "kept"), with_row(spark.range(200, numPartitions=5).withColumn("text", F.repeat("id", F.lit(2)))))
    kept = spark.read.parquet(path)
    names = kept.where("id % 2 = 0").select(ROW, F.lit("a").alias("who"))
    names = names.union(kept.where("id % 10 = 0 or id > 150").select(ROW, F.lit("b").alias("who"))).localCheckpoint()
    slices = in_slices(kept, path, names, most)
    assert sum(s.count() for s in slices) == names.count() and (len(slices) > 2) == (most < 100)
    got = sorted((r["id"], r["text"], r["who"]) for s in slices for r in s.collect())
    assert got == sorted((r["id"], r["text"], r["who"]) for r in kept.join(names, ROW).collect())
    assert all(s.join(names, ROW).count() and "BroadcastHashJoin" in plan_of(s) and "Exchange hashpartitioning" not in plan_of(s) for s in slices)
    empty = in_slices(kept, path, names.where("who = 'c'"), most)
    assert [s.count() for s in empty] == [0] and empty[0].columns == [ROW, "id", "text", "who"]


def test_a_failed_ingest_leaves_no_scratch_files(spark, feeds, tmp_path, monkeypatch):
    def failing(*_):
        raise RuntimeError("planted")

    monkeypatch.setattr(ingesting, "append_papers", failing)
    scratch = Path(shared_folder(spark).removeprefix("file:"))
    before = set(scratch.glob("scratch-*"))
    with pytest.raises(RuntimeError, match="planted"):
        run(spark, feeds, tmp_path, feed_requests(spark, ("r", "q", None, None, "a.xml")))
    assert set(scratch.glob("scratch-*")) == before
