"""Table and record layouts. Schemas are always given, never inferred."""

from pyspark.sql import types as T

# Defaults of the request formats and of the table layout.
DEFAULT_QUERY = "machine learning"
DEFAULT_MAX_RESULTS = 10
DEFAULT_TOP_K = 5
EMBEDDING_DIM = 1024
BATCH_BOUNDS = (1, 50)
NAME_LENGTH = 255
PAPER_ID_LENGTH = 50
ALL_TOPICS = "All Topics"
BUILT_IN_TOPICS = [
    "All Topics",
    "Machine Learning",
    "Quantum Computing",
    "Computer Vision",
    "Natural Language Processing",
    "Artificial Intelligence",
    "Deep Learning",
    "Reinforcement Learning",
]

TOPICS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

PAPERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("arxiv_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("authors", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("published_date", T.DateType()),
    T.StructField("categories", T.StringType()),
    T.StructField("topic_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("created_at", T.TimestampType()),
])

FEED_ENTRY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", T.StringType())]))),
])

INGEST_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("max_results", T.IntegerType()),
    T.StructField("topic_name", T.StringType()),
    T.StructField("feed", T.StringType()),
])

CHAT_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("topic_id", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
])
