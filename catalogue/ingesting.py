"""Ingest steps: what is new, keys, limits, account, and the whole job."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from paperlake.operators import ingest as ing
from paperlake.operators.embed import embed, embed_only
from paperlake.operators.keys import assign_ids, greatest_id
from paperlake.plans import ingest
from paperlake.session import cut, fresh_folder
from paperlake.sources import append_papers, ensure_tables, load_table, papers_from_feed, read_feed
from paperlake.schema import PAPERS

from .base import DIM, hash_embed_sql, papers, query, table 
from .models import FAILING_MARK, failing_hash_model, hash_model


# Text in a feed file, about.
FEED_BYTES = 32_000_000


def atom_entries(spark, folder):
    """Documents in the shape of feed entries, the id being an address."""
    return table(spark, folder, "documents").select(
        F.concat_ws("/", F.lit("http://arxiv.org/abs"), "lang", F.concat("doc_id", F.lit("v1"))).alias("id"),
        F.concat(F.lit("\n  On "), "source", F.lit("\n and "), "doc_id", F.lit(" ")).alias("title"),
        F.col("text").alias("summary"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int") % 900),
                      "yyyy-MM-dd'T'00:00:00'Z'").alias("published"),
        F.array(F.struct(F.col("source").alias("name")), F.struct(F.col("lang").alias("name"))).alias("author"),
        F.array(F.struct(F.col("lang").alias("_term"))).alias("category"),
    )


def broken_entries(spark, folder):
    """The same, every tenth with a date that can't be read."""
    entries = atom_entries(spark, folder)
    third = F.col("id").rlike("3v1$")
    return entries.withColumn("published", F.when(third, F.lit("soon")).otherwise(F.col("published")))


ENTRIES_SQL = """entries AS (
  SELECT doc_id, doc_id || 'v1' AS arxiv_id, CAST(doc_id AS VARCHAR) AS base_id,
         'On ' || source || '  and ' || doc_id AS title, source || '; ' || lang AS authors,
         replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' ') AS abstract,
         strftime(DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER), '%Y-%m-%d') AS published_date,
         lang AS categories, source
  FROM documents)"""


def write_feed(entries, path, least=None):
    """Feed files, ``least`` or as many as keep them at some ``FEED_BYTES`` of text; their number.

    A feed is read by one task. Without ``least`` they are as many as the entries have partitions.
    Files are compressed, and cut by their number of entries, so no text is shuffled.
    """
    writer = entries.write.format("xml").option("rowTag", "entry").option("rootTag", "feed")
    writer = writer.option("compression", "gzip")
    if least is None:
        writer.save(path)
        return None
    size, rows = entries.agg(F.sum(F.octet_length("summary")), F.count("*")).first()
    files = max(least, -(-(size or 0) // FEED_BYTES))
    writer.option("maxRecordsPerFile", max(1, -(-rows // files))).save(path)
    return max(1, len(read_feed(entries.sparkSession, path).inputFiles()))


@query(f"""
WITH {ENTRIES_SQL}
SELECT arxiv_id, base_id, title, authors, abstract, published_date, categories FROM entries""")
def papers_of_feeds(spark, folder):
    """All documents written as Atom files, read back as papers."""
    path = fresh_folder(spark, "feed")
    write_feed(atom_entries(spark, folder), path)
    found = papers_from_feed(read_feed(spark, path)).drop("feed", "position")
    return found.withColumn("published_date", F.col("published_date").cast("string"))


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def new_papers(spark, folder):
    batch = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    stored = table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("o_custkey")
    )
    return ing.new_papers(batch, stored, key="o_custkey").select("o_orderkey", "o_custkey")


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def new_papers_shuffled(spark, folder):
    """The same without the broadcast, as for a batch that is not small."""
    batch = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    stored = table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("o_custkey")
    )
    found = ing.new_papers(batch, stored, key="o_custkey", batch_rows=0)
    return found.select("o_orderkey", "o_custkey")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def first_of_copies(spark, folder):
    """One row per text: the first of all copies."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ing.dedupe_batch(docs, key="text", order=("doc_id",))


@query("""
SELECT event_id, user_id, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY ts, event_id) AS id
FROM events""")
def assigned_ids(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return assign_ids(events, greatest_id(events, "event_id"), ["ts", "event_id"]).select(
        "event_id", "user_id", "id"
    )


@query("""
WITH placed AS (
  SELECT user_id, event_id, user_id % 9 AS wanted,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
SELECT user_id, event_id, CAST(place AS BIGINT) AS place FROM placed WHERE place <= wanted""")
def first_per_request(spark, folder):
    """Users as requests for as many events as the last digit base 9 of their id."""
    events = table(spark, folder, "events").withColumn("wanted", F.col("user_id") % 9)
    first = ing.limit_per_request(events, "user_id", "wanted", ("ts", "event_id"))
    return first.select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("""
WITH placed AS (
  SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS place,
         CASE o_orderstatus WHEN 'P' THEN 5000 ELSE 3 END AS wanted FROM orders)
SELECT o_orderkey, place FROM placed WHERE place <= wanted""")
def first_of_large_requests(spark, folder):
    """The same for few large groups, too large for a window in one task."""
    orders = table(spark, folder, "orders").withColumn(
        "wanted", F.when(F.col("o_orderstatus") == "P", 5000).otherwise(3)
    )
    first = ing.limit_per_request(
        orders, "o_orderstatus", "wanted", ("o_orderdate", "o_orderkey")
    )
    return first.select("o_orderkey", "place")


@query("""
WITH outcomes AS (
  SELECT user_id AS request_id, event_type FROM events),
failures AS (
  SELECT request_id, event_type || '=' || count(*) AS failure FROM outcomes
  WHERE event_type IN ('error', 'purchase') GROUP BY request_id, event_type)
SELECT o.request_id, count(*) AS fetched, count(*) FILTER (event_type IN ('view', 'click')) AS processed,
       count(*) FILTER (event_type NOT IN ('view', 'click', 'error', 'purchase')) AS skipped,
       count(*) FILTER (event_type IN ('error', 'purchase')) AS failed,
       coalesce((SELECT string_agg(failure, ', ' ORDER BY failure) FROM failures f
                 WHERE f.request_id = o.request_id), '') AS failures
FROM outcomes o GROUP BY o.request_id""")
def ingest_summary(spark, folder):
    """Events as outcomes: views and clicks stored, errors and purchases failed."""
    kind = F.col("event_type")
    outcomes = table(spark, folder, "events").select(
        F.col("user_id").alias("request_id"),
        F.when(kind.isin("view", "click"), "stored")
        .when(kind.isin("error", "purchase"), "failed")
        .otherwise("skipped")
        .alias("outcome"),
        F.when(kind.isin("error", "purchase"), kind).alias("reason"),
    )
    listed = F.transform("failures", lambda f: F.concat_ws("=", f["reason"], f["n"]))
    return ing.ingest_summary(outcomes).withColumn("failures", F.array_join(listed, ", "))


@query("""
WITH placed AS (
  SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place
  FROM documents)
SELECT source, string_agg(doc_id || ':' || lang, ',' ORDER BY place) AS papers
FROM placed WHERE place <= 5 GROUP BY source""")
def previews(spark, folder):
    shown = ing.preview(
        table(spark, folder, "documents"), 5, ("doc_id", "lang"), "source", ("doc_id",)
    )
    listed = F.transform("papers", lambda p: F.concat_ws(":", p["doc_id"], p["lang"]))
    return shown.select("source", F.array_join(listed, ",").alias("papers"))


@query(f"""
WITH {hash_embed_sql('text', 'item_id', '(SELECT doc_id AS item_id, text FROM documents)')}
SELECT item_id AS doc_id, bucket, round(CAST(value AS DOUBLE), 6) AS value FROM hashed""")
def embedded_by_model(spark, folder):
    """A model called in batches from Python; its vectors are those of the hash embedder."""
    made = embed(
        table(spark, folder, "documents").select("doc_id", "text"), "text", lambda: hash_model(DIM), DIM
    )
    return made.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where(
        F.col("value") != 0
    ).select(
        "doc_id",
        F.col("bucket").cast("long").alias("bucket"),
        F.round(F.col("value").cast("double"), 6).alias("value"),
    )


@query(f"""
WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents),
tried AS (
  SELECT lang, doc_id, place,
         contains(source || chr(10) || chr(10) || text, '{FAILING_MARK}') AS failed, source
  FROM placed WHERE place <= 3),
totals AS (SELECT lang, count(*) AS total_papers_fetched FROM documents GROUP BY lang)
SELECT lang AS request_id, total_papers_fetched, count(*) FILTER (NOT failed) AS embeddings_generated,
       coalesce(string_agg('Embedding failed for ' || source || '...: cannot embed this text', '|'
         ORDER BY source) FILTER (failed), '') AS embedding_errors,
       string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY place) AS sample_papers
FROM tried JOIN totals USING (lang) GROUP BY lang, total_papers_fetched""")
def embed_only_trial(spark, folder):
    """The first three papers of each language, with a model that fails on a mark."""
    batch = table(spark, folder, "documents").select(
        F.col("lang").alias("request_id"),
        F.col("source").alias("title"),
        F.col("text").alias("abstract"),
        F.lit("").alias("authors"),
        F.col("doc_id").cast("string").alias("arxiv_id"),
        F.lit(None).cast("date").alias("published_date"),
        "doc_id",
    )
    tried = embed_only(batch, lambda: failing_hash_model(DIM), 3, DIM, ("doc_id",))
    return tried.select(
        "request_id",
        "total_papers_fetched",
        "embeddings_generated",
        F.array_join("embedding_errors", "|").alias("embedding_errors"),
        F.array_join("sample_papers.arxiv_id", ",").alias("sample_papers"),
    )


@query("""
SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS arxiv_id, source || ' no. ' || doc_id AS title,
       text AS abstract, CAST(substr(source, 4) AS BIGINT) AS topic_id
FROM documents""")
def appended_papers(spark, folder):
    """Half of the topics appended, then the rest, then read as one table."""
    path = fresh_folder(spark, "papers")
    rows = cut(papers(spark, folder).withColumn("published_date", F.lit(None).cast("date")))
    append_papers(rows.where("topic_id < 10"), path)
    stored = load_table(spark, path, PAPERS)
    append_papers(ing.new_papers(rows, stored), path)
    return load_table(spark, path, PAPERS).select("id", "arxiv_id", "title", "abstract", "topic_id")


@query(f"""
WITH {ENTRIES_SQL},
{hash_embed_sql("title || chr(10) || chr(10) || abstract", 'arxiv_id', 'entries')},
norm_checks AS (SELECT arxiv_id, round(sum(CAST(value AS DOUBLE) * bucket), 4) AS weight
                FROM hashed GROUP BY arxiv_id)
SELECT arxiv_id, title, authors, abstract, published_date, categories, weight
FROM entries JOIN norm_checks USING (arxiv_id)""")
def ingested_papers(spark, folder):
    """Feeds through the whole ingest job, twice; the second run adds nothing."""
    feed, stored, names = (fresh_folder(spark, x) for x in ("feed", "papers", "topics"))
    write_feed(atom_entries(spark, folder), feed, 8)
    entries = read_feed(spark, feed)
    asked = cut(entries.select("feed").distinct().select(
        F.col("feed").alias("request_id"),
        F.lit("documents").alias("query"),
        F.lit(2**31 - 1).alias("max_results"),
        F.lit(None).cast("string").alias("topic_name"),
        "feed",
    ))
    for _ in range(2):
        ingest(asked, entries, stored, names, lambda: hash_model(DIM), DIM).release()
    weight = F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") * i), F.lit(0.0), lambda s, x: s + x
    )
    return load_table(spark, stored, PAPERS).select(
        "arxiv_id",
        "title",
        "authors",
        "abstract",
        F.col("published_date").cast("string"),
        "categories",
        F.round(weight, 4).alias("weight"),
    )


def _with_failures(spark, folder, journal=None, runs=1):
    """The whole job over feeds with bad dates and a model that fails on some texts."""
    feed, stored, names = (fresh_folder(spark, x) for x in ("feed", "papers", "topics"))
    write_feed(broken_entries(spark, folder), feed, 4)
    entries = read_feed(spark, feed)
    asked = cut(entries.select("feed").distinct().select(
        F.lit("all").alias("request_id"),
        F.lit("documents").alias("query"),
        F.lit(2**31 - 1).alias("max_results"),
        F.lit(None).cast("string").alias("topic_name"),
        "feed",
    ))
    for _ in range(runs):
        result = ingest(asked, entries, stored, names, lambda: failing_hash_model(DIM), DIM, journal=journal)
    return result


FAILURES_SQL = f"""outcomes AS (
  SELECT arxiv_id, CASE WHEN doc_id % 10 = 3 THEN 'bad date'
                        WHEN contains(title || chr(10) || chr(10) || abstract, '{FAILING_MARK}')
                        THEN 'cannot embed this text' END AS reason
  FROM entries)"""


ACCOUNT_SQL = f"""
WITH {ENTRIES_SQL}, {FAILURES_SQL},
counted AS (SELECT reason || '=' || count(*) AS failure FROM outcomes WHERE reason IS NOT NULL GROUP BY reason)
SELECT 'all' AS request_id, 200 AS status, count(*) AS fetched, count(*) FILTER (reason IS NULL) AS processed,
       count(*) FILTER (reason IS NOT NULL) AS failed,
       (SELECT string_agg(failure, ', ' ORDER BY failure) FROM counted) AS failures
FROM outcomes"""


def _account(result):
    listed = F.transform("failures", lambda f: F.concat_ws("=", f["reason"], f["n"]))
    return result.responses.select(
        "request_id", "status", F.col("total_papers_fetched").alias("fetched"),
        F.col("processed_count").alias("processed"), "failed", F.array_join(listed, ", ").alias("failures"),
    )


@query(ACCOUNT_SQL)
def ingest_responses(spark, folder):
    """The account of the ingest job, with the model's own words for what it could not embed."""
    return _account(_with_failures(spark, folder))


@query(ACCOUNT_SQL)
def repeated_ingest_responses(spark, folder):
    """The same account by a run that finds all papers stored, as after a failure of the first run."""
    return _account(_with_failures(spark, folder, fresh_folder(spark, "journal"), 2))


@query(f"""
WITH {ENTRIES_SQL}, {FAILURES_SQL}
SELECT arxiv_id, CASE reason WHEN 'bad date' THEN reason ELSE 'missing vector' END AS reason,
       CASE reason WHEN 'bad date' THEN NULL ELSE reason END AS embed_error
FROM outcomes WHERE reason IS NOT NULL""")
def ingest_rejects(spark, folder):
    """The rows that the ingest job set aside."""
    return _with_failures(spark, folder).rejected.select(
        "arxiv_id", F.array_join("reasons", "; ").alias("reason"), "embed_error"
    )


@query("""SELECT doc_id AS id, CAST(doc_id AS VARCHAR) AS arxiv_id, source || ' no. ' || doc_id AS title FROM documents""")
def ensured_tables(spark, folder):
    """Catalog tables made in a database of their own, made again, appended to and read by name."""
    database = f"lake_{uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    for _ in range(2):
        stored, _ = ensure_tables(spark, database)
    rows = papers(spark, folder).withColumn("published_date", F.lit(None).cast("date"))
    append_papers(cut(rows), stored)
    return load_table(spark, stored).select("id", "arxiv_id", "title")
